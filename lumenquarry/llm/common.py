"""Helpers shared by the operators: checkpoints, Arrow batches, free column names, null texts, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space of the contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one ordered block of a distributed rank or prefix sum aims at.
BLOCK_ROWS = 1024
#: Blocks whose totals one task puts in order.
RUN = 4096


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: spark.checkpoint.dir, which all machines share.

    Only where that is unset (tests, a laptop) a temporary one is made.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, unless PYTHONPATH gives it to them already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lumenquarry_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "lumenquarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "lumenquarry").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._lumenquarry_shipped = True


def in_slices(batches, rows: int = 512):
    """The batches in slices of few rows, so that what is made of them stays small; Spark bounds a batch's bytes itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has a column of that name in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def blocks_for(rows: int, least: int = 16, target: int = BLOCK_ROWS) -> int:
    """How many hash blocks keep each near `target` rows."""
    return max(least, -(-rows // target))


def unit(seed: str, *keys: str) -> Column:
    """A seeded number in [0, 1) of the key columns, from 52 bits of an md5, that any SQL engine can recompute."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def unit_sql(seed: str, *keys: str) -> str:
    """DuckDB text of unit()."""
    parts = ", ".join(f"coalesce(cast({k} as varchar), 'null')" for k in keys)
    return f"(cast(('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 13)) as bigint) / {float(1 << 52)!r})"


def with_offsets(
    df: DataFrame, group: list[str], block: str, amount: Column, name: str, totals_from: DataFrame | None = None
) -> DataFrame:
    """Add `name`: the sum of `amount` over all earlier blocks of the row's group.

    One row per (group, block) is aggregated first, so the ordered windows see only block totals, RUN of them in one
    task, and the totals of such runs. totals_from: a cheaper frame of the same rows to aggregate.
    """
    sums = (df if totals_from is None else totals_from).groupBy(*group, block).agg(F.sum(amount).alias("__sum"))
    sums = sums.withColumn("__run", F.floor(F.col(block) / RUN))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    runs = sums.groupBy(*group, "__run").agg(F.sum("__sum").alias("__sum"))
    runs = runs.select(*group, "__run", so_far("__sum", earlier(group, "__run")).alias("__base"))
    sums = sums.withColumn("__in", so_far("__sum", earlier([*group, "__run"], block)))
    sums = sums.join(runs, [*group, "__run"]).select(*group, block, (F.col("__base") + F.col("__in")).alias(name))
    return df.join(sums, [*group, block])
