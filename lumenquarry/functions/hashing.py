"""Merkle trees over a table: sorted SHA-256 leaves, pairwise parents, an odd node paired with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.operators.graph import cut
from lumenquarry.operators.ordering import places


def merkle_levels(leaves: DataFrame, value: str, group: str) -> list[DataFrame]:
    """Levels from the leaves up, each (group, pos, hash); the last has one row per group.

    Leaves are ranked by hash once, in sorted ranges with offsets, so no task sees a whole group; a level halves
    positions, so each level is one aggregate of half the rows.
    """
    h = leaves.select(group, F.sha2(F.col(value).cast("string"), 256).alias("hash"))
    h = places(h, group, ["hash"], "pos")
    levels = [cut(h.select(group, (F.col("pos") - 1).alias("pos"), "hash"))]
    while levels[-1].where("pos > 0").limit(1).count():
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash")))
        up = levels[-1].groupBy(group, F.floor(F.col("pos") / 2).alias("pos")).agg(left.alias("l"), right.alias("r"), F.count("*").alias("n"))
        whole = F.sha2(F.concat("l", F.coalesce("r", "l")), 256)
        first = levels[-1].groupBy(group).agg(F.count("*").alias("size"))
        up = up.join(first, group).select(group, "pos", F.when(F.col("size") == 1, F.col("l")).otherwise(whole).alias("hash"))
        levels.append(cut(up))
    return levels


def merkle_root(leaves: DataFrame, value: str, group: str) -> DataFrame:
    """Rows (group, root)."""
    return merkle_levels(leaves, value, group)[-1].where("pos = 0").select(group, F.col("hash").alias("root"))


def merkle_proof(leaves: DataFrame, value: str, group: str, wanted: DataFrame) -> DataFrame:
    """Rows (group, leaf, proof, root) for wanted (group, leaf hash): proof is the siblings with their side, by sorted position."""
    levels = merkle_levels(leaves, value, group)
    path = levels[0].join(wanted.select(group, F.col("leaf").alias("hash")), [group, "hash"]).groupBy(group, F.col("hash").alias("leaf")).agg(F.min("pos").alias("pos"))
    path = path.withColumn("proof", F.array().cast("array<struct<side:string,hash:string>>"))
    for level in levels[:-1]:
        size = level.groupBy(group).agg(F.count("*").alias("size"))
        other = F.when(F.col("pos") % 2 == 0, F.col("pos") + 1).otherwise(F.col("pos") - 1)
        sib = level.select(group, F.col("pos").alias("other"), F.col("hash").alias("sh"))
        own = level.select(group, "pos", F.col("hash").alias("oh"))
        path = path.join(size, group).join(own, [group, "pos"]).withColumn("other", other).join(sib, [group, "other"], "left")
        step = F.struct(F.when(F.col("pos") % 2 == 0, "right").otherwise("left").alias("side"), F.coalesce("sh", "oh").alias("hash"))
        proof = F.when(F.col("size") > 1, F.concat("proof", F.array(step))).otherwise(F.col("proof"))
        path = path.select(group, "leaf", F.floor(F.col("pos") / 2).alias("pos"), proof.alias("proof"))
    root = levels[-1].where("pos = 0").select(group, F.col("hash").alias("root"))
    return path.join(root, group).select(group, "leaf", "proof", "root")


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """True where folding the siblings onto the leaf gives the root."""
    fold = lambda acc, p: F.sha2(F.when(p["side"] == "right", F.concat(acc, p["hash"])).otherwise(F.concat(p["hash"], acc)), 256)
    return F.aggregate(proof, leaf, fold) == root
