"""op10: language-model scores of all documents; a tenth is held out of training."""

from pyspark.sql import functions as F

from lumenquarry.llm.lm_scoring import score_documents

NAME = "op10_lm_scoring"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


SQL = None  # DuckDB has no crc32 and no such filter; tests hold counts and base scores against plain Python
