"""op8: all documents in sequences of 2048 tokens."""

from lumenquarry.llm.packing import pack_documents

NAME = "op8_packing"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


SQL = None  # token ids aren't SQL; tests hold them against plain encoding and check the packing's laws
