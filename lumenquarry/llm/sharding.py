"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores every key: -weight / ln(u), u a seeded hash of (key, shard) in (0, 1). The highest score
owns the key. A new shard can only take keys that it scores highest, so keys move into it and nowhere else,
and a shard's share follows its weight. Everything is a projection; only the slots need counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.llm.common import blocks_for, text_of, unit, unit_sql, with_offsets

SEED = "shard"


def rendezvous(key_col: str, weights: list[float], seed: str = SEED) -> Column:
    """The shard, 0 to len(weights) - 1, that owns the key. Equal scores: the lower shard. A null key is a key."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [
        F.struct((-F.lit(float(w)) / F.log(unit(f"{seed}:{i}", key_col) + F.lit(2.0**-54))).alias("score"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights)
    ]
    return (-(F.greatest(*scores)["i"] if len(scores) > 1 else F.lit(0))).cast("int")


def with_slots(rows: DataFrame, shard: str, key_col: str, blocks: int) -> DataFrame:
    """Add slot: a gapless number from 0 in each shard.

    Rows are ranked inside hash blocks of their shard; a block's offset is the count of the blocks before it.
    No task gathers a shard.
    """
    block = F.floor(unit("slot", key_col) * blocks).cast("int")
    rows = rows.withColumn("__block", block)
    rows = with_offsets(rows, [shard], "__block", F.lit(1), "__before")
    inside = Window.partitionBy(shard, "__block", "__before").orderBy(F.col(key_col).asc_nulls_first(), "text_crc32", "size")
    return rows.withColumn("slot", (F.col("__before") + F.row_number().over(inside) - 1).cast("long")).drop("__block", "__before")


def shard_documents(
    docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0
) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard.

    grown_shard is the owner once one more shard of grown_weight exists. A null text has no bytes. Rows that
    repeat an id get the same shard and different slots; null ids are one key. Empty table: empty result.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(id_col, weights).alias("shard"),
        rendezvous(id_col, [*weights, grown_weight]).alias("grown_shard"),
    )
    blocks = max(1, blocks_for(docs.count()) // len(weights))
    return with_slots(rows, "shard", id_col, blocks)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard; several files a shard, so that no task writes a whole one."""
    sharded.write.partitionBy("shard").parquet(path)
