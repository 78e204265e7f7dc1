"""Connected components of links: local union-find, then alternating star contractions (large star, small star)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import cut, ship_package

#: Links that one task joins by union-find before the rounds (16 bytes each).
LOCAL_LINKS = 500_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _local_stars(batches):
    parent: dict[int, int] = {}

    def find(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in list(parent)]
    out = [(x, r) for x, r in out if x != r]
    for at in range(0, len(out), 50_000):
        u, v = zip(*out[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame, rounds: int = 40, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Rows (node, component) for every end of a link (a, b); component is the smallest node of its component.

    Parts of at most about local_links links are first turned into stars by union-find. If there are several
    parts, each round points every node at the smallest node around it, once from above and once from below;
    the number of rounds grows with the logarithm of the longest path left. A centre's links are aggregated as
    minima, so no node's neighbourhood is held as a list. Raises if `rounds` don't settle the labels.
    """
    ship_package(links.sparkSession)
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = -(-edges.count() // local_links) or 1
    few = edges.coalesce(parts) if parts < edges.rdd.getNumPartitions() else edges
    edges = cut(few.mapInArrow(_local_stars, "u long, v long"))
    if edges.rdd.getNumPartitions() > 1:
        edges = _contract(edges, rounds)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _contract(edges: DataFrame, rounds: int) -> DataFrame:
    edges = cut(edges.distinct())
    before = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = _state(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")
