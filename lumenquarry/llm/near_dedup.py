"""Near-duplicate detection with HyperMinHash registers, banding, estimation and exact verification.

1. Each text becomes its set of shingle hashes and K compressed registers; equal sets become one class.
2. Bands of registers are hashed into buckets. Each class is tried against the smallest class of each of its
   buckets (a star, not all pairs): by the collision-corrected estimate, then on the full sets.
3. Components of the links found so far label the classes. A bucket whose members bear several labels may
   still hide a link between two of them. Those members only are compared, in blocks of bounded size, pairs
   of different labels alone; nothing but links between labels leaves a block. So a group of thousands of
   near copies costs its size, and no candidate is capped or dropped.
4. Components of all links give the answer.

A link is missed only if two texts over the threshold share no band of registers: (1 - 0.8**ROWS)**BANDS,
about 3 in a million at similarity 0.8 and less above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm import hyperminhash as hmh
from lumenquarry.llm.common import cut, fresh, in_slices, ship_package, text_of
from lumenquarry.llm.components import components

#: Members of one side of a block that is compared in one task.
BLOCK = 256
#: Members that are verified against one end of their links in one task.
STAR = 128
#: Ids that are broadcast to pick rows out of the documents (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _checked_broadcast(ids: DataFrame) -> DataFrame:
    """ids (checkpointed, one long column) as a broadcast side if their count is within BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, row_key, n, node, regs): set size, 64-bit digest of the set, registers; no words: null node."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in in_slices(batches):
            n, nodes, regs = [], [], []
            for text in batch.column(2).to_pylist():
                s = hmh.shingle_set(text, width)
                n.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                regs.append(hmh.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(regs, pa.binary())],
                ["id", "row_key", "n", "node", "regs"],
            )

    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("row_key"), text_of(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row_key long, n long, node long, regs binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, hashes) for wanted rows (row_key, node): the sets in full, 8 bytes a shingle."""
    rows = docs.select(_row_key(id_col, text_col).alias("row_key"), text_of(text_col).cast("binary").alias("text"))
    rows = rows.join(_checked_broadcast(wanted), "row_key").select("node", "text")

    def run(batches):
        for batch in in_slices(batches):
            hashes = [hmh.shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["node", "hashes"])
            of_node = [xxhash.xxh3_64_intdigest(h) - 2**63 == k for h, k in zip(hashes, batch.column(0).to_pylist(), strict=True)]
            yield out.filter(pa.array(of_node, pa.bool_()))  # another row whose key is the same has another set

    return rows.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _enough(common: np.ndarray, n, m, threshold: int) -> np.ndarray:
    return 100 * common >= threshold * (n + m - common)


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those whose estimate passes and whose full sets then reach the threshold percentage."""
    least = hmh.floor_estimate(threshold / 100)

    def estimated(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, hmh.K) for c in (2, 3))
            n, m = (batch.column(c).to_numpy() for c in (4, 5))
            ok = (hmh.estimate((x == y).mean(axis=1), n, m) >= least) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    def confirmed(key: tuple[pa.Scalar, ...], heads: pa.Table, members: pa.Table) -> pa.Table:
        ok = []
        if len(heads) and len(members):
            y = np.frombuffer(heads.column("hashes")[0].as_py(), np.uint64)
            for k in members.column("hashes"):
                x = np.frombuffer(k.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                ok.append(bool(_enough(np.count_nonzero(y[at] == x), len(x), len(y), threshold)))
        return members.select(["a", "b"]).filter(pa.array(ok, pa.bool_())) if ok else members.select(["a", "b"]).slice(0, 0)

    side = classes.select("node", "regs", "n")
    a, b = (side.select(F.col("node").alias(c), F.col("regs").alias(f"regs_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(estimated, "a long, b long")
    # a head's set goes to each STAR of its members, not to each pair
    pairs = cut(pairs)
    stars = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("stars")))
    members = pairs.join(stars, "b").withColumn("star", F.pmod(F.xxhash64("a"), F.col("stars")).cast("int"))
    members = members.select("a", "b", "star").join(sets.withColumnRenamed("node", "a"), "a")
    heads = stars.select("b", F.explode(F.sequence(F.lit(0), F.col("stars") - 1)).alias("star")).join(sets.withColumnRenamed("node", "b"), "b")
    heads = heads.select(F.col("b").alias("head"), F.col("star").alias("head_star"), F.col("hashes").alias("hashes"))  # new columns, told apart from the members'
    return heads.groupBy("head", "head_star").cogroup(members.groupBy("b", "star")).applyInArrow(confirmed, "a long, b long")


def _label_links(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between classes of different labels that share a bucket; members (bucket, node, label).

    Members with a bucket's commonest label are one side only: among themselves they need no link.
    """
    per_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    kinds = per_label.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("m"), F.max("n").alias("n_most"), F.count("*").alias("labels")
    )
    kinds = kinds.where("labels > 1 and m > 2").withColumn("few", F.col("m") - F.col("n_most"))
    kinds = cut(kinds.select("bucket", "most", F.ceil(F.col("m") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.col("few") / BLOCK).cast("int").alias("few_blocks")))
    rows = members.join(kinds, "bucket").withColumn("is_few", F.col("label") != F.col("most"))
    one = (F.col("all_blocks") == 1) & (F.col("few_blocks") == 1)
    h = F.xxhash64("node", F.lit(7))
    mine, theirs = (F.pmod(h, F.col(c)).cast("int") for c in ("all_blocks", "few_blocks"))
    as_all = F.transform(F.sequence(F.lit(0), F.col("few_blocks") - 1), lambda i: F.struct(i.alias("f"), mine.alias("o"), F.lit(1).alias("role")))
    as_few = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda i: F.struct(theirs.alias("f"), i.alias("o"), F.lit(2).alias("role")))
    none = F.slice(as_all, 1, 0)
    both = F.array(F.struct(F.lit(0).alias("f"), F.lit(0).alias("o"), F.when(F.col("is_few"), 3).otherwise(1).alias("role")))
    places = F.when(one, both).otherwise(F.concat(as_all, F.when(F.col("is_few"), as_few).otherwise(none)))
    rows = rows.select("bucket", "node", "label", F.explode(places).alias("p")).select("bucket", "node", "label", "p.*")
    rows = rows.join(classes.select("node", "regs", "n"), "node")
    least = hmh.floor_estimate(threshold / 100)

    def likely(t: pa.Table):
        """For each member of role 2, members of role 1 with another label whose estimate passes."""
        role, label, size = (t.column(c).to_numpy() for c in ("role", "label", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, hmh.K)
        other = np.flatnonzero(role & 1)
        for i in np.flatnonzero(role & 2):
            j = other[label[other] != label[i]]
            j = j[100 * np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i])]
            j = j[hmh.estimate((regs[j] == regs[i]).mean(axis=1), size[j], np.full(len(j), size[i])) >= least]
            if len(j):
                yield i, j

    def taking_part(t: pa.Table) -> pa.Table:
        used = np.zeros(len(t), bool)
        for i, j in likely(t):
            used[i] = used[j] = True
        return t.filter(pa.array(used))

    def run(t: pa.Table) -> pa.Table:
        node, label, size = (t.column(c).to_numpy() for c in ("node", "label", "n"))
        sets = [np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()]
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(values), bool)
        out = []
        for i, j in likely(t):
            own = ids[first[i] : first[i + 1]]
            mark[own] = True
            common = np.array([np.count_nonzero(mark[ids[first[k] : first[k + 1]]]) for k in j])
            mark[own] = False
            j = j[_enough(common, size[j], size[i], threshold)]
            _, one_each = np.unique(label[j], return_index=True)  # a link to a label is enough
            out += [(node[i], node[k]) for k in j[one_each]]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # sets in full go only to members with an estimate that passes
    rows = rows.select("bucket", "f", "o", "node", "label", "role", "regs", "n")
    fields = "bucket long, f int, o int, node long, label long, role int, regs binary, n long"
    rows = cut(rows.groupBy("bucket", "f", "o").applyInArrow(taking_part, fields)).join(sets, "node")
    return rows.groupBy("bucket", "f", "o").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, row_key.

    Documents are linked where 100 * |both| >= threshold * |either| on their sets of shingles of `width` words.
    component_id is the smallest id that links reach. A null, empty or blank text has no shingles, is linked
    with nothing and kept. Copies are one class and share its component. Rows that repeat an id are told apart
    by their text; a null id is never the smallest unless its component has no other. Empty table: empty result.
    row_key is a hash of id and text, by which a caller can find the row again.
    """
    sk = cut(sketches(docs, width, id_col, text_col))
    have = sk.where("node is not null")
    classes = cut(
        have.groupBy("node").agg(F.min("id").alias("id"), F.min("row_key").alias("row_key"), F.max("n").alias("n"), F.max("regs").alias("regs"))
    )
    size = 2 * hmh.ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(hmh.BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * size + 1, F.lit(size)))
    )
    bands = classes.select("node", F.explode(bands).alias("bucket"))
    buckets = cut(bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("m")).where("m > 1"))
    members = cut(bands.join(buckets, "bucket"))
    wanted = members.select("node").distinct().join(classes, "node").select("row_key", "node")
    sets = cut(_sets(docs, cut(wanted), width, id_col, text_col))
    stars = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = cut(_verified(stars, classes, sets, threshold))
    labels = components(links)
    told = members.where("m > 2").join(labels, "node", "left")
    told = told.select("bucket", "node", F.coalesce("component", "node").alias("label"))
    more = cut(_label_links(told, classes, sets, threshold))
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    labelled = classes.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = cut(labelled.groupBy("component").agg(F.min("id").alias("component_id")))  # a plain side, so that a large component can be split
    answer = labelled.select("node", "component").join(lowest, "component").select("node", "component_id")
    rows = have.select("id", "row_key", "n", "node").join(answer, "node").drop("node")
    rows = rows.unionByName(sk.where("node is null").select("id", "row_key", "n", F.col("id").alias("component_id")))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        "row_key",
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one of each component: that of the smallest id. Options: near_duplicates().

    Rows that repeat id and text stay or go together; texts without words stay. No column name clashes.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    key, row = fresh("__key", docs), fresh("__row", docs)
    gone = cut(found.where("not kept").select(F.col("row_key").alias(key), F.col(id_col).alias(row)).distinct())
    same = (_row_key(id_col, text_col) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(row))
    return docs.join(_checked_broadcast(gone), same, "left_anti")
