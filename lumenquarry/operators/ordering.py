"""Orders over whole tables without one task that sees them all: ranges are sorted apart, offsets join them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators.graph import cut

#: Rows of a block of a numbered series, beside the rows that it repeats of the block before it.
BLOCK_ROWS = 8192


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds __part, the sorted range of a row, and __at, its place in the range from 0; ties stay in an arbitrary fixed order."""
    place = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumn("__id", place))
    return rows.select(*df.columns, F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit(2**33 - 1)).alias("__at"))


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per range, the sums over all ranges before it: a row for each range, so the window is small and the result broadcast."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return F.broadcast(per.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums]))


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the place of each row in the order, from 1."""
    rows = in_ranges(df, order)
    rows = rows.join(_offsets(rows, {"__before": F.lit(1)}), "__part")
    return rows.withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("long")).drop("__part", "__at", "__before")


def running_sums(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds sum_<column> over all rows up to the current one in the order, which must be total."""
    rows = in_ranges(df, order)
    rows = rows.join(_offsets(rows, {f"__{c}": F.col(c) for c in columns}), "__part")
    w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"sum_{c}": F.col(f"__{c}") + F.sum(c).over(w) for c in columns})
    return rows.drop("__part", "__at", *[f"__{c}" for c in columns])


def places(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in its key's order, from 1; no task sees a whole key."""
    rows = positions(df, [by, *order], "__place")
    first = cut(rows.groupBy(F.col(by).alias("__by")).agg(F.min("__place").alias("__first")))
    rows = rows.join(first, F.col(by).eqNullSafe(F.col("__by")))
    return rows.withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__by", "__first")


def blocks_of_series(df: DataFrame, by: str, order: list[str], overlap: int) -> DataFrame:
    """Rows of each key's series in blocks: adds __block, and __copy for the `overlap` rows that a block repeats of the one before.

    A window partitioned by (by, __block) sees up to `overlap` earlier rows of every row that isn't a copy, so a hot
    key is many tasks. The caller drops the copies.
    """
    rows = places(df, by, order, "__n")
    size = max(BLOCK_ROWS, 2 * overlap)
    n = F.col("__n") - 1
    block = F.floor(n / size)
    own = F.array(F.struct(block.alias("b"), F.lit(False).alias("c")))
    copied = F.array(F.struct(block.alias("b"), F.lit(False).alias("c")), F.struct((block + 1).alias("b"), F.lit(True).alias("c")))
    rows = rows.withColumn("__p", F.explode(F.when(n % size >= size - overlap, copied).otherwise(own)))
    return rows.select(*df.columns, F.col("__p.b").alias("__block"), F.col("__p.c").alias("__copy"))
