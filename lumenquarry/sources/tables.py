"""Read-only SQL over the tables of a folder, their sizes, and range partitions of a written table."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquarry.session import TABLES, table

_READS = re.compile(r"\s*(?:select|with|values)\b", re.I)


def run_query(spark: SparkSession, folder: str, text: str, **values) -> DataFrame:
    """A read-only query over the folder's tables, named as views; values fill :name parameters. Anything else is refused."""
    if not _READS.match(text):
        raise ValueError("only queries that read are run")
    used = [n for n in TABLES if re.search(rf"\b{n}\b", text, re.I)]
    for n in used:
        table(spark, folder, n).createOrReplaceTempView(n)
    return spark.sql(text, args=values or None)


def run_queries(spark: SparkSession, folder: str, texts: list[str]) -> DataFrame:
    """Results of several queries of the same columns, with query_no from 0. Each is atomic by itself only."""
    return reduce(DataFrame.unionByName, [run_query(spark, folder, x).withColumn("query_no", F.lit(i)) for i, x in enumerate(texts)])


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, n) of every table."""
    return reduce(DataFrame.unionAll, [table(spark, folder, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in TABLES])


def write_ranges(rows: DataFrame, column: str, path: str, fmt: str = "yyyy-MM") -> None:
    """Write a table in partitions by a time column's month (or `fmt`), so that a range of time reads its folders only."""
    rows.withColumn("range", F.date_format(column, fmt)).write.mode("append").partitionBy("range").parquet(path)


def drop_ranges(spark: SparkSession, path: str, before: str) -> list[str]:
    """Remove the partitions whose name sorts before a bound; gives their names."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("range=")]
    gone = sorted(n for n in names if n.removeprefix("range=") < before)
    for n in gone:
        fs.delete(fs_path(f"{path}/{n}"), True)
    return [n.removeprefix("range=") for n in gone]


def timed(queries: list[Callable[[], DataFrame]], rounds: int = 3) -> dict[str, float]:
    """Seconds of running the queries in turn: mean, min, max, p95, and queries a second."""
    took = []
    for _ in range(rounds):
        for q in queries:
            began = time.perf_counter()
            q().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
    took.sort()
    total = sum(took)
    return {"mean": total / len(took), "min": took[0], "max": took[-1], "p95": took[min(len(took) - 1, int(0.95 * len(took)))], "qps": len(took) / total}
