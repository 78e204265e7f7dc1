"""op9: near-duplicates of documents on two-word shingles."""

from lumenquarry.llm.near_dedup import near_duplicates

NAME = "op9_near_dedup"


def query(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, threshold=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL = None  # all pairs in SQL take too long on whole tables; tests hold it against brute force
