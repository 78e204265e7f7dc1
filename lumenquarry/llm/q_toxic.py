"""op1: toxicity of all documents, learned from the labelled rows that aren't held out."""

from pyspark.sql import functions as F

from lumenquarry.llm.toxicity import fit, score

NAME = "op1_toxicity"


def held_out(id_col="doc_id"):
    """True for a fifth of the ids, whose labels are never read."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels, held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None  # a fitted model isn't SQL; tests measure it on held-out rows
