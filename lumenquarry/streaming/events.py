"""Structured Streaming forms of the time-based operators, driven by files that come into a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; `ts` becomes a timestamp with zone, which watermarks need.

    Files come in order of their modification times, `files_per_trigger` a batch. Each batch moves the watermark, so
    rows that a later file brings from before it are dropped by the windows: a replay of old files needs a wide
    watermark, more files a batch, or files written in order of time.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, by: str, value: str) -> DataFrame:
    """Windowed count, mean, max per key; rows later than the watermark are dropped."""
    return _stats(events.withWatermark("ts", late).groupBy(F.window("ts", width), by), value, by)


def sliding(events: DataFrame, width: str, step: str, late: str, by: str, value: str) -> DataFrame:
    return _stats(events.withWatermark("ts", late).groupBy(F.window("ts", width, step), by), value, by)


def sessions(events: DataFrame, gap: str, late: str, by: str, value: str) -> DataFrame:
    """Session windows per key."""
    return _stats(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), by), value, by)


def _stats(grouped, value: str, by: str) -> DataFrame:
    agg = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total", "top")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first of the events with a key, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


PROFILE = "user_id long, events long, total double, threat string"


def actor_profiles(events: DataFrame, limit: float) -> DataFrame:
    """Per actor, running count and sum across batches, and a threat once the sum passes a limit."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "threat": ["high" if total > limit else "none"]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, PROFILE, "n long, total double", "update", "NoTimeout")


def apply_changes(changes: DataFrame, target: str, key: list[str], order: list[str], deleted: Column, checkpoint: str):
    """Keep `target` (Parquet, one folder per version) at the latest state of a change stream, batch by batch.

    A batch is merged into the last version and written as a new one, so a failed batch leaves the old state whole;
    a repeated batch writes the same version again.
    """
    from lumenquarry.sources.cdc import latest

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.withColumn("__deleted", deleted)
        if batch_id > 0:
            now = spark.read.parquet(f"{target}/v{batch_id - 1}").unionByName(now)
        last = latest(now, key, order, F.lit(False))
        last.write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, batches: int) -> DataFrame:
    """The state after a number of batches, without deleted keys."""
    return spark.read.parquet(f"{target}/v{batches - 1}").where("not __deleted").drop("__deleted")


def in_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a function over every micro-batch until the source is empty."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def collected(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All rows that a finite stream emits, written by the executors beside the checkpoint; none pass the driver.

    A batch is a folder of its own, so a repeated batch overwrites itself. In complete mode the last batch is the result.
    """
    spark, folder, done = stream.sparkSession, f"{checkpoint}-{name}", []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{batch_id}")
        done.append(batch_id)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/v{i}" for i in kept])
