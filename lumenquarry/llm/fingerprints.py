"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in DataFrame functions only.

The leaves of a text are its sentences (long ones in pieces), their parents its paragraphs (lines), then its
sections (parted by an empty line), then the root. A node's hash is the SHA-256 of its children's hashes, so
equal roots mean equal texts, and comparing two trees from the root down leads to the branches that differ.
The fingerprint string holds the root and a short hash of every leaf, parted like the text:
root:leaf,leaf;leaf/leaf with "," in a paragraph, ";" between paragraphs and "/" between sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.llm.common import cut, text_of

#: A leaf: up to this many characters and the sentence marks after them. Everything belongs to some leaf.
LEAF = r"[^.!?]{1,40}[.!?]*|[.!?]+"
#: Hexadecimal digits of a leaf that the fingerprint string keeps.
SHORT = 8
#: Rows that a block of neighbouring ids aims at, and the most boundaries drawn from the ids' distribution.
NEIGHBOURS, BOUNDARIES = 1500, 1024
#: Blocks whose first ids are broadcast (24 bytes each).
BROADCAST_BLOCKS = 200_000


def tree(text: Column) -> Column:
    """Array of sections, each an array of paragraphs, each an array of the SHA-256 of its leaves."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def root(hashes: Column) -> Column:
    """Root of a tree of leaf hashes."""
    node = lambda children: F.sha2(F.concat_ws("", children), 256)
    return node(F.transform(hashes, lambda s: node(F.transform(s, node))))


def fingerprint(hashes: Column) -> Column:
    """The string form of a tree of leaf hashes."""
    short = lambda p: F.concat_ws(",", F.transform(p, lambda x: F.substring(x, 1, SHORT)))
    return F.concat(root(hashes), F.lit(":"), F.concat_ws("/", F.transform(hashes, lambda s: F.concat_ws(";", F.transform(s, short)))))


def _leaves(fp: Column) -> Column:
    return F.array_remove(F.split(F.substring_index(fp, ":", -1), "[,;/]", -1), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves in both over those of each; 1 for equal roots, whatever the texts."""
    x, y = F.array_distinct(_leaves(a)), F.array_distinct(_leaves(b))
    of_each = F.size(x) + F.size(y)
    shared = F.when(of_each > 0, 2 * F.size(F.array_intersect(x, y)) / of_each).otherwise(0.0)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(shared)


def changed_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph) numbers from 0, compared place by place.

    Branches below equal hashes aren't entered; a section or paragraph that only one text has is reported.
    """
    parts = lambda fp: F.split(F.substring_index(fp, ":", -1), "/", -1)
    paragraphs = lambda s: F.split(F.coalesce(s, F.lit("-")), ";", -1)
    x, y = parts(a), parts(b)
    indexes = lambda n: F.sequence(F.lit(0), n - 1)

    def in_section(i):
        p, q = F.get(x, i), F.get(y, i)
        pp, qq = paragraphs(p), paragraphs(q)
        where = F.filter(indexes(F.greatest(F.size(pp), F.size(qq))), lambda j: ~F.get(pp, j).eqNullSafe(F.get(qq, j)))
        return F.when(p.eqNullSafe(q), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(where, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        )

    return F.flatten(F.transform(indexes(F.greatest(F.size(x), F.size(y))), in_section))


def _below(bounds: Column, x: Column) -> Column:
    """How many of sorted bounds aren't beyond x: coarse steps of 32 first."""
    n = F.size(bounds)
    steps = F.size(F.filter(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda i: F.get(bounds, i * 32) <= x))
    fine = F.slice(bounds, F.greatest(steps - 1, F.lit(0)) * 32 + 1, 32)
    return F.when((n == 0) | (steps == 0), 0).otherwise((steps - 1) * 32 + F.size(F.filter(fine, lambda b: b <= x)))


def _blocked(docs: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """docs with __block, a non-decreasing number of the id, about NEIGHBOURS rows each, and how many blocks at most.

    Boundaries are quantiles of the ids in two levels of at most BOUNDARIES each (sketches of bounded size, the second
    one for each interval of the first), so blocks follow the ids' distribution up to BOUNDARIES**2 blocks. Null ids
    come first, in a block of their own.
    """
    n = docs.count()
    x = F.col(id_col)
    quantiles = lambda k: F.percentile_approx(id_col, [i / k for i in range(1, k)], 10 * BOUNDARIES)
    count = max(1, min(BOUNDARIES, n // NEIGHBOURS))
    inner = min(BOUNDARIES, -(-n // (count * NEIGHBOURS))) if count == BOUNDARIES else 1
    at = docs.agg(quantiles(count).alias("q")).first()["q"] if count > 1 else []
    coarse = _below(F.array(*map(F.lit, sorted(set(at or [])))) if at else F.array().cast("array<long>"), x) if at else F.lit(0)
    rows = docs.withColumn("__block", F.when(x.isNull(), -1).otherwise(coarse).cast("long"))
    if inner == 1:
        return rows, count + 1
    ids = docs.select(id_col).withColumn("__block", F.when(x.isNull(), -1).otherwise(coarse).cast("long"))
    fine = cut(ids.where("__block >= 0").groupBy("__block").agg(F.array_distinct(quantiles(inner)).alias("__fine")))
    rows = rows.join(F.broadcast(fine), "__block", "left")  # at most BOUNDARIES rows of BOUNDARIES numbers
    block = F.when(x.isNull(), -1).otherwise(F.col("__block") * inner + _below(F.col("__fine"), x)).cast("long")
    return rows.withColumn("__block", block).drop("__fine"), count * inner + 1


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """The rows with next_<column> of the row with the next id; after the last comes the first.

    Ids are dealt into neighbouring blocks of bounded size. The first rows of a block are also sent to the block
    before it, so each block is ordered for itself and the table is shuffled once. Rows of equal id follow each
    other in the order of `columns`; null ids come first.
    """
    rows, blocks = _blocked(docs.select(id_col, *columns), id_col)
    firsts = cut(rows.select(id_col, "__block").groupBy("__block").agg(F.min(id_col).alias("__first")))
    # the block before: in a run of BOUNDARIES block numbers, else the last of the run before it, else the last of all
    firsts = firsts.withColumn("__run", F.floor(F.col("__block") / BOUNDARIES))
    runs = firsts.groupBy("__run").agg(F.max("__block").alias("__last"))
    every = Window.orderBy("__run")
    runs = runs.select("__run", F.coalesce(F.lag("__last").over(every), F.max("__last").over(Window.partitionBy())).alias("__back"))
    firsts = firsts.join(runs, "__run").select(
        "__block", "__first", F.coalesce(F.lag("__block").over(Window.partitionBy("__run").orderBy("__block")), F.col("__back")).alias("__before")
    )
    # a row of 24 bytes for each block; beyond the bound Spark picks the join
    rows = rows.join(F.broadcast(firsts) if blocks <= BROADCAST_BLOCKS else firsts, "__block")
    halo = F.col(id_col).eqNullSafe(F.col("__first"))
    places = F.when(halo, F.array(
        F.struct(F.col("__block").alias("b"), F.lit(False).alias("halo")), F.struct(F.col("__before").alias("b"), F.lit(True).alias("halo"))
    )).otherwise(F.array(F.struct(F.col("__block").alias("b"), F.lit(False).alias("halo"))))
    rows = rows.select(id_col, *columns, F.explode(places).alias("__p"))
    rows = rows.select(id_col, *columns, F.col("__p.b").alias("__block"), F.col("__p.halo").alias("__halo"))
    order = Window.partitionBy("__block").orderBy("__halo", F.col(id_col).asc_nulls_first(), *columns)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where("not __halo").drop("__block", "__halo")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are whole numbers. The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's. A null text is empty. A single document is its own next. Empty table: empty result.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    rows = rows.withColumn("fp", fingerprint(tree(F.col("text"))))
    rows = with_next(rows, ["text", "fp"], id_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), F.col("fp"), F.col("next_fp"), edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(tree(F.col("edited"))).alias("edited_fp"))
    return rows.select(
        id_col, "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
