"""The block scan of vectors against the pair-by-pair one, and the queries that must use it."""

import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import retrieval as R
from lumenquarry.operators import vectors as V
from lumenquarry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
BY_BLOCKS = [
    "dense_search",
    "dense_normalized",
    "embedding_quality",
    "hard_queries",
    "hybrid_borda",
    "hybrid_combsum",
    "hybrid_max",
    "hybrid_rrf",
    "hybrid_rrf_normalized",
    "hybrid_three_ways",
    "hybrid_weighted",
    "metrics_aggregate",
    "mmr_diversify",
    "retrieval_metrics",
    "search_modes",
    "similarity_edges",
    "vector_precedents",
    "blended_rerank",
    "cross_document_edges",
    "hybrid_min",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, zeros, nulls, NaN, another length and near ties."""
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)]) for i in range(80)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [1.0, 2.0]), (204, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(300 + i, [1.0, 1e-7 * i, 0.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    return v, v.where("vec_id % 3 = 0 or vec_id between 200 and 204").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("most", [10_000, 9])
def test_nearest_equals_pairs(odd, monkeypatch, earlier, most):
    v, q = odd
    apart = F.col("vec_id") < F.col("query_id") if earlier else F.lit(True)
    want = rows(R.nearest(v, q, 5, among=apart))
    monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(V, "ROWS", 16)
    assert rows(R.nearest(v, q, 5, earlier=earlier)) == want


def test_pairs_and_ends_equal_pairs(odd):
    v, q = (x.where(f"{c} <> 204") for x, c in zip(odd, ("vec_id", "query_id"), strict=True))
    s = R.against_all(v, q, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    assert rows(R.pairs_at_least(v, q, 0.4)) == rows(s.where("score >= 0.4"))
    assert rows(R.cosine_ends(v, q)) == rows(s.agg(F.min("score").alias("low"), F.max("score").alias("high")))


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_scan_is_by_blocks(spark, monkeypatch, name):
    """No query forms its pairs of vectors row by row."""

    def pairs(*_):
        raise AssertionError("pair by pair")

    monkeypatch.setattr(R, "against_all", pairs)
    assert QUERIES[name](spark, SF).columns
