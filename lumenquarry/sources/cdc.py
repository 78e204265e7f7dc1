"""Change records: the latest state of a table, and versions of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The last change of each key, without keys whose last change deletes them.

    An aggregate, not a ranking: a key with many changes combines before the shuffle.
    """
    row = F.struct(*changes.columns)
    last = changes.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")
    return last.where(~deleted)


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of changes in place of, or beside, its own."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
