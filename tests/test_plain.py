"""Operators that SQL doesn't express, and orders over many ranges, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import text
from lumenquarry.operators import graph, knowledge, models, ordering, quality, retrieval, rules, timeseries
from lumenquarry.plans.catalog import queries
from lumenquarry.sources import tables

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return queries()[name](spark, SF).collect()


def read(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def test_order_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(6)
    got = {r.i: r for r in ordering.positions(df, ["v", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    assert [got[r[1]].position for r in order] == list(range(1, 301))
    sums = {r.i: r.sum_v for r in ordering.running_sums(df, ["v", "i"], ["v"]).collect()}
    assert [sums[r[1]] for r in order] == list(np.cumsum([r[2] for r in order]))
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        own[r[0]].append(r)
    for r in ordering.places(df, "k", ["i"], "n").collect():
        assert own[r.k][r.n - 1][1] == r.i
    for r in timeseries.rolling(df.where("k is not null"), "k", ["i"], "v", 5).collect():
        at = [x[1] for x in own[r.k]].index(r.i)
        last = [x[2] for x in own[r.k][max(0, at - 4) : at + 1]]
        assert (r.r_count, r.r_min, r.r_max) == (len(last), min(last), max(last)) and math.isclose(r.r_mean, np.mean(last))


def test_unwanted_query(spark):
    texts = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    for r in rows_of(spark, "text_unwanted"):
        t = texts[r.doc_id]
        for pattern in text.UNWANTED:
            t = re.sub(pattern, "", t, flags=re.ASCII)
        want = re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")
        assert r.digest == hashlib.md5(want.encode()).hexdigest()


def test_clean_query(spark):
    texts = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    steps = [(r"[ \t]+", " "), (r"https?://\S+", ""), (r"www\.\S+", ""), (r"\S+@\S+", ""), (r"<[^>]+>", ""), (r"(.)\1{3,}", r"\1\1"), (r"[\x00-\x1F\x7F-\u009F]", ""), (r"\s+", " ")]
    for r in rows_of(spark, "text_clean"):
        t = (texts[r.doc_id] or "").translate(str.maketrans("يكى", "یکی"))
        for k, (pattern, to) in enumerate(steps):
            t = re.sub(pattern, to, t, flags=re.ASCII)
            t = t.strip(" ") if k == 0 else t
        assert r.cleaned == t.strip(" ")


def test_components_and_labels(spark):
    edges = {(r.l_suppkey + 1000000, r.l_partkey) for r in read(spark, "lineitem").select("l_suppkey", "l_partkey").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {(r.component, r.n) for r in rows_of(spark, "graph_components_supply")} == set(Counter(find(x) for x in root).items())
    lines = {(r.l_orderkey, r.l_linenumber): r.l_partkey for r in read(spark, "lineitem").collect()}
    near = defaultdict(set)
    pairs = defaultdict(list)
    for r in read(spark, "lineitem").collect():
        pairs[r.l_orderkey, r.l_linenumber].append(r.l_partkey)
    for (o, n), parts in pairs.items():
        for a in parts:
            for b in pairs.get((o, n + 1), ()):
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
    assert lines
    label = {x: x for x in near}
    for _ in range(5):
        votes = {x: Counter(label[y] for y in near[x]) for x in near}
        label = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
    assert {r.id: r.label for r in rows_of(spark, "graph_label_propagation")} == label


def unit(rows):
    x = np.array([r.embedding for r in rows], float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def test_greedy_dedup(spark):
    rows = sorted(read(spark, "embeddings").collect(), key=lambda r: r.vec_id)
    u, kept = unit(rows), []
    for i in range(len(rows)):
        if not kept or (u[kept] @ u[i]).max() <= 0.5:
            kept.append(i)
    assert {r.vec_id for r in rows_of(spark, "greedy_semantic_dedup")} == {rows[i].vec_id for i in kept}
    close = {(rows[i].vec_id, rows[j].vec_id) for i in range(len(rows)) for j in range(i + 1, len(rows)) if u[i] @ u[j] > 0.3}
    df = read(spark, "embeddings")
    assert {tuple(r) for r in knowledge.similar_vector_pairs(df, "vec_id", "embedding", 0.3, block=60).collect()} == close
    texts = {}
    for r in read(spark, "conversations").collect():
        k = int(r.conv_id) * 1000 + r.turn
        texts[k] = min(r.text, texts.get(k, r.text))
    sets = {k: set(t.lower().split()) for k, t in texts.items()}
    kept = []
    for k in sorted(sets):
        if not any(len(sets[k] & sets[j]) > 0.6 * len(sets[k] | sets[j]) for j in kept):
            kept.append(k)
    assert {r.id for r in rows_of(spark, "greedy_token_dedup")} == set(kept)


def test_mmr_query(spark):
    dense = defaultdict(list)
    for r in rows_of(spark, "dense_search"):
        dense[r.query_id].append((r.vec_id, r.score))
    rows = read(spark, "embeddings").collect()
    u = dict(zip([r.vec_id for r in rows], unit(rows), strict=True))
    got = defaultdict(list)
    for r in rows_of(spark, "mmr_diversify"):
        got[r.query_id].append((r.rank, r.vec_id))
    for q, hits in dense.items():
        picked, left = [], dict(hits)
        while left and len(picked) < 10:
            value = {v: 0.7 * s - 0.3 * max([0.0, *(float(u[v] @ u[p]) for p in picked)]) for v, s in left.items()}
            best = min(left, key=lambda v: (-value[v], v))
            picked.append(best)
            del left[best]
        assert [v for _, v in sorted(got[q])] == picked


def test_semantic_chunks_query(spark):
    by = defaultdict(list)
    for r in read(spark, "embeddings").collect():
        by[r.label].append(r)
    got = {(r.label, r.vec_id): r.chunk for r in rows_of(spark, "semantic_chunks")}
    for label, rows in by.items():
        rows.sort(key=lambda r: r.vec_id)
        u = unit(rows)
        sims = [float(u[i] @ u[i - 1]) for i in range(1, len(u))]
        limit, chunk, held = np.mean(sims) - 0.5 * np.std(sims), 0, 1
        assert got[label, rows[0].vec_id] == 0
        for i in range(1, len(rows)):
            if held >= 2 and (held >= 8 or sims[i - 1] < limit):
                chunk, held = chunk + 1, 0
            held += 1
            assert got[label, rows[i].vec_id] == chunk


def test_fitted_queries(spark):
    rows = [(((r.quality - 0.5) * 4 + (math.fmod(r.doc_id, 7) - 3) / 3), r.quality) for r in read(spark, "labels").collect()]
    loss = lambda t: -sum(math.log(max(1e-12, 1 / (1 + math.exp(-z / t)) if y else 1 - 1 / (1 + math.exp(-z / t)))) for z, y in rows)
    heat = rows_of(spark, "temperature_fit")[0].temperature
    best = min(loss(0.05 * 1.02**k) for k in range(303))
    assert loss(heat) <= best + 0.02 * abs(best) + 0.02
    for r in rows_of(spark, "propensity_logistic"):
        assert all(v is None or math.isfinite(v) for v in r)
    li = read(spark, "lineitem").collect()
    x = np.array([[r.l_extendedprice, r.l_discount, r.l_extendedprice * (1 - r.l_discount), r.l_extendedprice * (1 - r.l_discount) * (1 + r.l_tax)] for r in li])
    m, n = np.corrcoef(x.T), len(li)
    names = ["l_extendedprice", "l_discount", "revenue", "charge"]
    want = [(names[i], names[j]) for i, j in models.skeleton(m, n)]
    assert [(r.a, r.b) for r in rows_of(spark, "causal_skeleton")] == want


def test_propensity_equals_newton(spark):
    """The effect with propensities of a regularised logistic regression fitted here by Newton's method."""
    c = read(spark, "customer").collect()
    x = np.array([[r.c_acctbal, r.c_nationkey] for r in c], float)
    y = np.array([r.c_mktsegment == "BUILDING" for r in c], float)
    sd = x.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(len(x)), x / sd])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([0, 0.01, 0.01])
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge, z.T @ (p - y) / len(y) + ridge @ w)
    p = dict(zip([r.c_custkey for r in c], np.clip(1 / (1 + np.exp(-z @ w)), 0.01, 0.99), strict=True))
    t = dict(zip([r.c_custkey for r in c], y, strict=True))
    o = [(t[r.o_custkey], p[r.o_custkey], r.o_totalprice) for r in read(spark, "orders").collect() if r.o_custkey in p]
    one, none = sum(a / b for a, b, _ in o), sum((1 - a) / (1 - b) for a, b, _ in o)
    want = sum(a / b * v for a, b, v in o) / one - sum((1 - a) / (1 - b) * v for a, b, v in o) / none
    assert math.isclose(rows_of(spark, "propensity_logistic")[0].ate, want, rel_tol=0.02, abs_tol=5)


def test_opposed(spark):
    made = [("it is more", "it is less", True), ("the dog runs", "the dog never runs", True), ("the dog runs", "a cat sleeps not", False), ("that dog", "this dog", False), ("", "", False)]
    df = spark.createDataFrame(made, "a string, b string, want boolean")
    got = df.select("want", knowledge.opposed(F.col("a"), F.col("b"), [("more", "less")], {"that": "the", "this": "the"}).alias("x")).collect()
    assert all(r.want == r.x for r in got)
    for r in rows_of(spark, "opposed_turns"):
        assert r.opposed in (True, False)


def test_term_spans(spark):
    t = "The year. COST of costs, year's Price"
    got = knowledge.term_spans(spark.createDataFrame([(1, t)], "doc_id long, text string"), {"m": r"\b(?:price|cost)\w*", "t": r"\byears?\b"}).collect()
    want = [("m", m[0], *m.span()) for m in re.finditer(r"(?i)\b(?:price|cost)\w*", t)] + [("t", m[0], *m.span()) for m in re.finditer(r"(?i)\byears?\b", t)]
    assert sorted((r.category, r.term, r.start, r.end) for r in got) == sorted(want)


def test_linear_dag_and_gaussian_process(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    b = 1.5 * a + rng.normal(size=4000)
    c = -1.0 * b + 0.5 * rng.normal(size=4000)
    w = knowledge.linear_dag(np.cov(np.array([a, b, c])))
    linked = {frozenset(map(int, x)) for x in np.argwhere(w)}
    assert linked >= {frozenset({0, 1}), frozenset({1, 2})}
    power = np.linalg.matrix_power(np.abs(w) + 0.0, 3)
    assert np.trace(power) < 1e-6
    df = spark.createDataFrame([("g", float(x), float(math.sin(x))) for x in np.linspace(0, 6, 200)], "g string, x double, y double")
    got = {r.x: r for r in knowledge.gaussian_process(df, "g", "x", "y", [1.0, 3.0, 30.0], 1.0).collect()}
    assert abs(got[1.0].mean - math.sin(1)) < 0.05 and abs(got[3.0].mean - math.sin(3)) < 0.05
    assert got[30.0].std > 0.9 > 10 * got[1.0].std
    assert rows_of(spark, "linear_dag") and len(rows_of(spark, "gaussian_process")) == 20
    assert all(0 <= r.p <= 1 for r in rows_of(spark, "temperature_model"))


def test_unification():
    p = rules.parse_term
    assert rules.unify(p("f(X, g(a))"), p("f(b, Y)")) == {"X": "b", "Y": ("g", "a")}
    assert rules.unify(p("f(X, X)"), p("f(a, b)")) is None
    assert rules.unify(p("X"), p("f(X)")) is None
    assert rules.unify(p("f(X, Y, Z)"), p("f(Y, Z, c)")) == {"X": "c", "Y": "c", "Z": "c"}
    assert rules.unify(p("f(a)"), p("g(a)")) is None
    for bad in ("f(", "f(a))", "", "f(a b)"):
        with pytest.raises((ValueError, IndexError)):
            p(bad)


def test_explanations_reach_facts(spark):
    facts = spark.createDataFrame([("edge", ["a", "b"]), ("edge", ["b", "c"]), ("edge", ["c", "d"])], "predicate string, args array<string>")
    d = rules.derivations(facts, [rules.Rule.parse("path(X, Y) :- edge(X, Y)"), rules.Rule.parse("path(X, Z) :- edge(X, Y), path(Y, Z)")])
    assert {tuple(r.args) for r in d.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}
    lines = rules.explained(d, d.where("args = array('a', 'd')").select("predicate", "args")).orderBy("step").collect()
    assert [r.line for r in lines] == ["path(a, d) by rule 1 from edge(a, b) and path(b, d)", "path(b, d) by rule 1 from edge(b, c) and path(c, d)", "path(c, d) by rule 0 from edge(c, d)"]


def test_tables(spark, tmp_path):
    assert tables.run_query(spark, SF, "select count(*) as n from nation where n_regionkey = :r", r=1).first().n == 5
    with pytest.raises(ValueError):
        tables.run_query(spark, SF, "drop table nation")
    tables.write_ranges(read(spark, "events"), "ts", str(tmp_path / "e"), "yyyy-MM-dd")
    before = spark.read.parquet(str(tmp_path / "e")).count()
    gone = tables.drop_ranges(spark, str(tmp_path / "e"), "2024-01-05")
    assert gone == [f"2024-01-0{k}" for k in range(1, 5)] and spark.read.parquet(str(tmp_path / "e")).count() < before
    took = tables.timed([lambda: read(spark, "region")], 2)
    assert took["min"] <= took["mean"] <= took["max"] and took["qps"] > 0


def test_weights_and_scores(spark):
    w = knowledge.learned_weights([(1.0, {"a": 0.5, "b": 0.1})] * 150, {"a": 0.5, "b": 0.5})
    assert math.isclose(sum(w.values()), 1) and w["a"] > w["b"]
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "query_id long, q array<double>")
    v = spark.createDataFrame([(100 + i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, retrieval.nearest(v, q, 3).collect()))
    retrieval.BROADCAST_QUERIES, old = 7, retrieval.BROADCAST_QUERIES
    try:
        assert sorted(map(tuple, retrieval.nearest(v, q, 3).collect())) == want
    finally:
        retrieval.BROADCAST_QUERIES = old
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (1, 4, 2.0), (5, 6, 1.0)], "src long, dst long, weight double")
    assert {(r.src, r.dst): r.active for r in graph.capped(e, 2).collect()} == {(1, 2): False, (1, 3): True, (1, 4): True, (5, 6): True}
    h = spark.createDataFrame([("a", n) for n in (5, 4, 4, 1)] + [("b", 1), ("c", 9)], "k string, n long")
    assert {r.k: r.h for r in graph.h_index(h, "k", "n").collect()} == {"a": 3, "b": 1, "c": 1}
    ks = quality.ks_statistic(spark.createDataFrame([(x, x < 5) for x in range(10)], "x long, r boolean"), "x", F.col("r"))
    assert ks.first()[0] == 1.0


def test_communities(spark):
    """Two cliques with a bridge are two communities; moving raises modularity over single nodes and label propagation."""
    clique = lambda a: [(a + i, a + j) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([*clique(0), *clique(10), (0, 10)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16), 99]], "id long")
    got = {r.id: r.label for r in graph.communities(nodes, edges).collect()}
    assert got[99] == 99 and len({got[i] for i in range(6)}) == 1 == len({got[i] for i in range(10, 16)}) and got[1] != got[11]
    both = graph.both_ways(edges).collect()
    q = graph.modularity(edges, graph.communities(nodes, edges)).first()[0]
    label = got
    inside = sum(label[r.src] == label[r.dst] for r in both) / len(both)
    share = Counter(label[r.src] for r in both)
    assert math.isclose(q, inside - sum((n / len(both)) ** 2 for n in share.values()))
    e = queries()["graph_communities"](spark, SF)
    assert e.count() == 200
