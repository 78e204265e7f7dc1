"""op2: Merkle fingerprints of documents and of their edited texts."""

from lumenquarry.llm.fingerprints import compare_with_edits

NAME = "op2_fingerprints"


def query(spark, sf_dir):
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None  # the tree is nested; tests hold it against plain Python
