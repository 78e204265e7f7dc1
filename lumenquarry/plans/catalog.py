"""Every query of the engine outside the llm subpackage, with its SQL oracle."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lumenquarry.plans.base import QUERIES, SQL

AREAS = ("text", "retrieval", "quality", "timeseries", "graph", "rules", "sqlviews", "streams", "legal", "models", "catalogs", "knowledge")

for area in AREAS:
    import_module(f"lumenquarry.plans.{area}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_rrf"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
