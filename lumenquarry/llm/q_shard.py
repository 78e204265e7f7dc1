"""op4: documents on shards by rendezvous hashing; eight equal shards, then nine."""

from pyspark.sql import functions as F

from lumenquarry.llm.sharding import shard_documents

NAME = "op4_sharding"
SHARDS = 8


def query(spark, sf_dir):
    rows = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SQL = None  # DuckDB has no crc32; tests hold the query against a plain Python version
