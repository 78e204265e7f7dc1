"""Predicates and score adjustments: a metadata filter compiler, policy and validity filters, boosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Privacy levels in order.
PRIVACY = ("public", "internal", "confidential", "restricted")


def compile_filter(where: dict) -> Column:
    """A predicate of a metadata filter: scalar: equal; list: one of; {"$gt"|"$gte"|"$lt"|"$lte": v}: range; all must hold.

    An empty filter matches nothing.
    """
    if not where:
        return F.lit(False)
    ops = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}

    def one(key: str, value) -> Column:
        if isinstance(value, (list, tuple, set)):
            return F.col(key).isin(*value)
        if isinstance(value, dict) and value.keys() <= ops.keys():
            return reduce(Column.__and__, [getattr(F.col(key), ops[o])(v) for o, v in value.items()])
        return F.col(key) == (str(value) if isinstance(value, dict) else value)

    return reduce(Column.__and__, [one(k, v) for k, v in where.items()])


def privacy_rank(level: Column) -> Column:
    """Ordinal of a privacy level; null and unknown ones are public."""
    return reduce(lambda acc, kv: F.when(level == kv[1], kv[0]).otherwise(acc), list(enumerate(PRIVACY))[1:], F.lit(0))


def boosted(base: Column, *boosts: Column) -> Column:
    """The base score plus boosts, at most 1."""
    return F.least(F.lit(1.0), reduce(Column.__add__, boosts, base))


def diversity_penalty(text: Column, order: list[Column], factor: float = 0.9) -> Column:
    """factor for rows whose first 100 characters an earlier row has; else 1."""
    seen = F.row_number().over(Window.partitionBy(F.md5(F.substring(text, 1, 100))).orderBy(*order))
    return F.when(seen > 1, factor).otherwise(1.0)


def recency_boost(age_days: Column, most: float = 0.2, days: int = 365) -> Column:
    """1 + most * (1 - age / days) below `days`, else 1."""
    return F.when(age_days < days, 1 + most * (1 - age_days / days)).otherwise(1.0)


def keep_confident(rows: DataFrame, uncertainty: str, order: list[str], threshold: float = 0.2, least: int = 3) -> DataFrame:
    """Rows under the threshold or without uncertainty, topped up to `least` with others in input order."""
    sure = F.col(uncertainty).isNull() | (F.col(uncertainty) < threshold)
    rows = rows.withColumn("__sure", sure)
    n = rows.agg(F.sum(F.col("__sure").cast("int")).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__sure").orderBy(*order))
    spare = rows.where("not __sure").orderBy(*order).limit(least).withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    spare = spare.join(F.broadcast(n)).where(F.col("__rank") <= least - F.col("__n"))  # one row
    del rank
    return rows.where("__sure").drop("__sure").unionByName(spare.drop("__sure", "__rank", "__n"))
