"""op3: personal data in documents."""

from pyspark.sql import functions as F

from lumenquarry.llm.pii import KINDS, find, listed

NAME = "op3_pii"


def query(spark, sf_dir):
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


SQL = None  # DuckDB's expressions give no match positions; tests hold the query against plain Python
