"""Exact de-duplication by a 128-bit content hash, with a byte comparison inside groups.

Method: rows are grouped by the md5 of the text together with the text itself, so equality of the grouping
key is equality of bytes and a hash collision gives two groups, not one. The aggregate combines copies before
the shuffle, so a group of any size sends at most one row per map task. Rows then find their group by the
hash alone (some tens of bytes a row; Spark splits a hot hash in that join). Only where one hash holds two
texts do the texts take part in the join as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import cut, text_of


def _hash(text):
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", hash_of=_hash
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" (the method's smallest stable id) or "max". A null text counts as empty. A null id never wins
    against another; in a group of null ids only, keep_id is null and every row is kept. Rows that repeat the
    winning id with the same text are all reported as kept. An empty table gives an empty result. Other
    columns are ignored, whatever their names. hash_of exists so that tests can force collisions.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__h", hash_of(F.col("__text")))
    groups = rows.groupBy("__h", "__text").agg(best("__id").alias("keep_id"), F.count("*").alias("group_size"))
    per_hash = groups.groupBy("__h").agg(
        F.count("*").alias("__texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    several = cut(per_hash.where("group_size > 1 or __texts > 1"))
    facts = rows.select("__id", "__h", F.sha2("__text", 256).alias("text_sha256"))
    collided = several.where("__texts > 1").select("__h")
    if collided.isEmpty():
        found = facts.join(several, "__h", "left")
    else:
        found = facts.join(several.where("__texts = 1"), "__h", "left").join(collided, "__h", "left_anti")
        part = rows.join(collided, "__h", "left_semi")
        apart = part.groupBy("__h", "__text").agg(best("__id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = part.join(apart, ["__h", "__text"]).withColumn("text_sha256", F.sha2("__text", 256))
        found = found.unionByName(apart.drop("__text"), allowMissingColumns=True)
    keep_id = F.coalesce("keep_id", "__id")
    return found.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def distinct_texts(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row for each distinct text: that of the smallest (or largest) id.

    Null and empty texts are one group; the row that stays keeps its own text. Equal ids with equal texts give
    one row; a null id stays only if its group has no other. The whole row travels as the aggregate's value, so
    copies combine before the shuffle and the table is read once.
    """
    others = [c for c in docs.columns if c != text_col]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    row = F.struct(*fields, F.col(text_col).isNull().alias("none"))
    order = F.struct(F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull(), F.col(id_col))
    best = F.min_by if keep == "min" else F.max_by
    text = text_of(text_col)
    g = docs.groupBy(_hash(text).alias("__h"), text.alias("__text")).agg(best(row, order).alias("__row"))
    out = {c: F.col(f"__row.c{i}") for i, c in enumerate(others)}
    out[text_col] = F.when(~F.col("__row.none"), F.col("__text"))
    return g.select(*[out[c].alias(c) for c in docs.columns])
