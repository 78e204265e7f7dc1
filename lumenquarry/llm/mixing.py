"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Each source wants total * weight / sum(weights), but at most epochs * its own size. The excess of clamped
sources is shared again by weight until none is above its cap. The fixed point of that process has a closed
form: with sources in order of cap / weight, those below the water level are clamped. So one window over the
(small) table of sources replaces the rounds.

A source that is to be read r = target / size times takes every document floor(r) times, and once more the
documents that come first in a seeded order, until the target is met; the document at the edge gives only its
first words. Prefix sums run in hash blocks of a source, so a hot source never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.llm.common import WORD, blocks_for, cut, text_of, unit, with_offsets

SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, total: Column, epochs: float) -> DataFrame:
    """Add target to rows (source_size, weight).

    A source is clamped if the level that the sources not clamped before it share reaches its cap.
    If all caps together are below the total, every source is clamped. Sources without words get 0.
    """
    sources = sources.withColumn("__cap", F.lit(float(epochs)) * F.col("source_size"))
    sources = sources.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    by_ratio = Window.orderBy("__ratio", "__order").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = sources.withColumns({
        "__filled": F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0.0)),
        "__lighter": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
        "__weights": F.sum("weight").over(everything),
    })
    level = (total - F.col("__filled")) / (F.col("__weights") - F.col("__lighter"))
    sources = sources.withColumn("__level", level)
    # levels fall from the first open source on, so the greatest of them is the water level
    open_level = F.max(F.when(F.col("__level") < F.col("__ratio"), F.col("__level"))).over(everything)
    first_open = F.min(F.when(F.col("__level") < F.col("__ratio"), F.col("__ratio"))).over(everything)
    sources = sources.withColumns({"__open": open_level, "__from": first_open})
    target = F.when(F.col("__from").isNull() | (F.col("__ratio") < F.col("__from")), F.col("__cap")).otherwise(
        F.col("weight") * F.col("__open")
    )
    return sources.withColumn("target", target)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repetitions counted).

    Sources are in code-point order, null last, and weigh `weights` in turn. The mix has share * all words.
    taken is whole repetitions * size, plus size for documents early in the seeded order, plus a part for the
    document at the edge; it never exceeds epochs * size. A null text has no words. Repeated ids are separate
    rows in an order fixed by id and size. Empty table: empty result. Reruns give the same rows. carry adds the
    input row as a struct named row, which travels through the one shuffle of the rows.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("__order"),
        n_words(text_of(text_col)).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    light = cut(rows.drop("row"))  # four short columns; unless rows are carried the texts are read once
    rows = rows if carry else light
    sources = light.groupBy("__order").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("__order")) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, (rank % len(weights)).cast("int")))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    sources = water_fill(sources.withColumn("__total", total), F.col("__total"), epochs)
    sources = sources.select("__order", "source_size", "target")
    blocks = blocks_for(light.count())
    block = F.floor(unit(SEED, "__id") * blocks).cast("int")
    rows, light = (x.withColumn("__u", unit(SEED, "__id")).withColumn("__block", block) for x in (rows, light))
    rows = with_offsets(rows, ["__order"], "__block", F.col("size"), "__before", light)
    inside = (
        Window.partitionBy("__order", "__block", "__before").orderBy("__u", F.col("__id").asc_nulls_first(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("__at", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sources, "__order")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    whole = F.least(whole, F.lit(int(epochs))).cast("long")
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__at")))
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        "size", "source_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        *(["row"] if carry else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The first n words of the text with the white space before and between them; possessive, so linear and flat."""
    head = F.concat(F.lit("^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.call_function("regexp_extract", text, head, F.lit(0))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix: a row for each repetition, with the columns of docs.

    A fractional repetition has the first words of the text; n_chars, where there is such a column, follows.
    Documents without words cost nothing and stay once. options: those of mix().
    """
    rows = mix(docs, text_col=text_col, carry=True, **options).select("row", "size", "taken")
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("long")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")),
    )
    rows = rows.withColumn("words", F.explode(copies))
    text = F.when(F.col("words") < 0, F.col(f"row.{text_col}")).otherwise(first_words(F.col(f"row.{text_col}"), F.col("words")))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in docs.columns])
