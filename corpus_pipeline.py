"""The corpus pipeline: toxicity filter, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its rows are
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenquarry.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lumenquarry.llm.q_pack import tokenizer_path
from lumenquarry.llm.q_toxic import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below a half; the rest go.

    Null and empty texts are scored like any other and stay unless the model calls an empty text toxic. Equal texts, so
    repeated rows too, all stay or all go. A null id is never matched with a label. Without labels of both kinds the
    score is a constant below a half. Texts are read whole; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id.

    Null and empty texts are equal; the row that stays keeps its own. A null id stays only where no other has the text;
    repeated rows become one. An empty table stays empty.
    """
    return exact_dedup.distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked on five-word shingles at similarity 0.8 or more: that of the smallest id.

    Null, empty and blank texts have no shingles and all stay; shorter texts than five words are one shingle. Rows that
    repeat id and text stay or go together. An empty table stays empty.
    """
    return near_dedup.without_near_duplicates(docs, width=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole or fractional repetition that the weights of the sources call for.

    Null sources are a source of their own, the last. Texts without words cost nothing and stay once; a fractional
    repetition has the first words of its text. Documents of a source past its target go. The order inside a source is
    seeded by the id, ties by id and size, so reruns agree. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequence and place.

    Null and empty texts are the end id alone; texts of more than 2048 ids are cut into pieces, however long. Rows that
    repeat an id are packed each for itself. An empty table gives an empty result.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # a fitted model and token ids aren't SQL; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    from lumenquarry.llm.common import checkpoint_folder

    out = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
