"""Operators on small fixtures: sources, streams, rules, intervals, graphs, trees, fusion."""

import hashlib
import json
import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenquarry.functions import hashing, text
from lumenquarry.operators import filters, graph, models, retrieval, rules
from lumenquarry.sources import cdc, files
from lumenquarry.streaming import events as S


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x", "title": "T"}\nbroken\n{"_id": "2", "contents": "y"}\n{"doc_id": "3"}\n')
    assert sorted(map(tuple, files.read_documents(spark, str(tmp_path / "a.jsonl")).collect())) == [("1", "T\n\nx"), ("2", "y")]
    (tmp_path / "b.json").write_text(json.dumps([{"doc_id": "4", "content": "z"}]))
    assert files.read_documents(spark, str(tmp_path / "b.json")).collect()[0].text == "z"
    (tmp_path / "c.csv").write_text('id,text\n5,"a, b"\n')
    assert tuple(files.read_documents(spark, str(tmp_path / "c.csv")).first()) == ("5", "a, b")


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    p = retrieval.postings(docs)
    files.write_index(p, str(tmp_path / "i"), 4)
    assert files.index_is_valid(p, str(tmp_path / "i"))
    assert sorted((r.id, r.tf) for r in files.lookup_terms(spark, str(tmp_path / "i"), ["a", "c"], 4).collect()) == [(1, 2), (2, 1)]


def test_graph_files(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a<",), ("b",)], "id string"), spark.createDataFrame([("a<", "b")], "src string, dst string")
    files.write_graphml(nodes, edges, str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    parts = sorted((tmp_path / "g").glob("part-*"))
    root = ET.fromstring("".join(p.read_text() for p in parts))
    assert len(root.findall("graph/node")) == 2 and root.find("graph/edge").get("source") == "a<"
    files.write_dataset(spark.createDataFrame([(1, "train"), (2, "eval")], "x int, split string"), "split", str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/data")).count() == 2
    files.export_with_manifest(edges, F.col("dst"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/manifest")).first()["rows"] == 1


def test_change_stream(spark, tmp_path):
    schema = "k long, v string, seq long, op string"
    for i, rows in enumerate([[(1, "a", 1, "I"), (2, "b", 2, "I")], [(1, "c", 3, "U")], [(2, None, 4, "D"), (3, "d", 5, "I")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = S.apply_changes(stream, str(tmp_path / "t"), ["k"], ["seq"], F.col("op") == "D", str(tmp_path / "c"))
    q.awaitTermination()
    got = S.current(spark, str(tmp_path / "t"), 3)
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "c"), (3, "d")]
    assert cdc.upsert(got.select("k", "v"), spark.createDataFrame([(3, "e")], "k long, v string"), ["k"]).count() == 2


def test_session_stream(spark, tmp_path):
    rows = [(1, "u", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 5, 30, 33)] + [(2, "w", "2024-01-03 00:00:00", 2.0)]
    event = lambda rows: spark.createDataFrame(rows, "event_id long, user string, t string, value double").select("event_id", "user", F.col("t").cast("timestamp_ntz").alias("ts"), "value").coalesce(1)
    e = event(rows)
    e.write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), e.schema)
    got = S.collected(S.sessions(stream, "10 minutes", "1 hour", "user", "value"), "sess", "append", str(tmp_path / "c"))
    assert sorted((r.user, r.n) for r in got.collect()) == [("u", 2), ("u", 2)]  # the last session is still open


def test_late_rows_are_dropped(spark, tmp_path):
    """A file that comes after the watermark has passed its rows adds nothing; within the watermark it does."""
    import os

    schema = "event_id long, user string, ts timestamp_ntz, value double"
    days = [("2024-01-01 00:00:00", 1), ("2024-01-03 00:00:00", 2), ("2024-01-03 00:10:00", 3), ("2024-01-01 00:01:00", 4), ("2024-01-02 23:30:00", 5), ("2024-01-09 00:00:00", 6)]
    for i, (ts, n) in enumerate(days):
        spark.createDataFrame([(n, "u", ts, 1.0)], "event_id long, user string, t string, value double").selectExpr("event_id", "user", "cast(t as timestamp_ntz) as ts", "value").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"w{i}").glob("part-*"))
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
        part.rename(tmp_path / "in" / f"{i}.parquet")
    stream = S.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    got = S.collected(S.tumbling(stream, "1 day", "1 hour", "user", "value"), "late", "append", str(tmp_path / "c"))
    assert sorted((str(r.start.date()), r.n) for r in got.collect()) == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 2)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_fixpoint_equals_naive(spark, pairs):
    facts = spark.createDataFrame([("edge", [str(a), str(b)]) for a, b in pairs], "predicate string, args array<string>")
    closed = {(str(a), str(b)) for a, b in pairs}
    while True:
        more = {(a, d) for a, b in closed for c, d in closed if b == c} - closed
        if not more:
            break
        closed |= more
    out = rules.forward_chain(facts, [rules.Rule.parse("path(X, Y) :- edge(X, Y)"), rules.Rule.parse("path(X, Z) :- edge(X, Y), path(Y, Z)")])
    assert {tuple(r.args) for r in out.where("predicate = 'path'").collect()} == closed


def test_rule_text():
    r = rules.Rule.parse("p(X, Y) :- q(X, c), r(Y)")
    assert r.head.variables == ["X", "Y"] and rules.validate(r, {"p": 2, "q": 2}) == ["r/1"]
    for bad in ("p(X) :- q(Y)", "p(X)", "p(f(X)) :- q(X)"):
        with pytest.raises(ValueError):
            rules.Rule.parse(bad)


def test_allen(spark):
    cases = {
        "equals": (1, 5, 1, 5), "meets": (1, 3, 3, 5), "met_by": (3, 5, 1, 3), "before": (1, 2, 4, 5), "after": (4, 5, 1, 2), "starts": (1, 3, 1, 5),
        "started_by": (1, 5, 1, 3), "finishes": (3, 5, 1, 5), "finished_by": (1, 5, 3, 5), "during": (2, 3, 1, 5), "contains": (1, 5, 2, 3), "overlaps": (1, 4, 2, 5), "overlapped_by": (2, 5, 1, 4),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "want string, a int, b int, c int, d int")
    got = df.select("want", rules.allen(*[F.col(c) for c in "abcd"]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_merkle_small(spark):
    rows = [(n, f"v{i}") for n in (1, 2, 3, 5) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v string")

    def root(values):
        level = sorted(hashlib.sha256(v.encode()).hexdigest() for v in values)
        while len(level) > 1:
            level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    assert {r.g: r.root for r in hashing.merkle_root(df, "v", "g").collect()} == {n: root([f"v{i}" for i in range(n)]) for n in (1, 2, 3, 5)}


def test_graph_shapes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert [tuple(r) for r in graph.triangles(edges).collect()] == [(1, 2, 3)]
    assert abs(graph.pagerank(nodes, edges).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    b = {r.id: r.betweenness for r in models.betweenness(edges.withColumn("part", F.lit("x")), "part").collect()}
    assert b[3] == 2.0 and b[1] == 0.0
    labels = {r.id: r.label for r in graph.label_propagation(nodes, edges).collect()}
    assert labels[7] == 7 and labels[5] in (5, 6)


def test_fusion_and_filters(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2)], "query_id long, doc_id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 0.9, 1)], "query_id long, doc_id long, score double, rank long")
    lists = retrieval.ranked_lists(a=a, b=b)
    of = lambda how, **kw: {r.doc_id: r.score for r in retrieval.fuse(lists, how, **kw).collect()}
    assert of("rrf") == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6)}
    assert of("borda") == {10: 2.0, 11: 2.0} and of("min") == {11: 0.9} and of("max") == {10: 3.0, 11: 2.0}
    assert a.where(filters.compile_filter({})).count() == 0 and a.where(filters.compile_filter({"score": {"$gt": 2.5}})).count() == 1
    u = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.8), (4, None)], "id int, u double")
    assert sorted(r.id for r in filters.keep_confident(u, "u", ["id"]).collect()) == [1, 2, 4]


def test_text_functions(spark):
    df = spark.createDataFrame([("see http://a.b/c aaaaaa <b>x</b> me@x.org  end",)], "t string")
    row = df.select(text.clean(F.col("t")).alias("c"), text.without_unwanted(F.col("t")).alias("u"), text.scrub(F.col("t")).alias("s"), text.truncated(F.col("t"), 10).alias("k")).first()
    assert row.c == "see aa x end" and row.u == "see x me.org end" and "me@x.org" not in row.s and row.k == "see htt..."
    rng = random.Random(4)
    made = ["".join(rng.choice("aB1.@%-_ <>#/x\n") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    made += ["a@b.co.x@y.org", ".a@b.co", "..%x@y.zz|", "@@a a@ @a@b a@b@", "<<a>>b<c", "1234567890 09123456789 2024-01-02 2024/01/02 2024/1/2 021-1234567 02112345678", "IR" + "1" * 24, "1234 5678-9012 3456"]

    def python_redact(t):
        for pattern, label in text.REDACTIONS:
            t = re.sub(pattern, label, t, flags=re.ASCII)
        return t

    def python_unwanted(t):
        for pattern in text.UNWANTED:
            t = re.sub(pattern, "", t, flags=re.ASCII)
        return re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")

    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.redact(F.col("t")).alias("r"), text.without_unwanted(F.col("t")).alias("u")).collect()
    for r in rows:
        assert (r.r, r.u) == (python_redact(r.t), python_unwanted(r.t)), r.t
    long = spark.createDataFrame([(x * 200_000,) for x in ("a", "a.", "<", "<a", "1")] + [("a" * 200_000 + " x@y.org",), ("a." * 100_000 + " x@y.org",)], "t string").cache()
    long.count()
    began = time.perf_counter()
    long.select(*[F.length(f(F.col("t"))) for f in (text.redact, text.without_unwanted, text.clean, text.scrub)]).collect()
    assert time.perf_counter() - began < 20
    n = random.Random(0).randint(900, 1100)
    parts = text.chunks(spark.createDataFrame([(1, "x" * n), (2, ""), (3, "y" * 500)], "doc_id int, text string")).collect()
    assert max(r.end for r in parts if r.doc_id == 1) == n and [r.chunk for r in parts if r.doc_id == 3] == [0]


def test_files_by_kind(spark, tmp_path):
    """Word files are parsed, files without a parser have no text, loads are tried again, bytes come in chunks."""
    import zipfile

    d = tmp_path / "f"
    d.mkdir()
    (d / "a.txt").write_text("plain ü")
    (d / "b.pdf").write_bytes(b"%PDF\xff")
    (d / "c.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(d / "d.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text) for r in files.read_texts(spark, str(d)).collect()}
    assert got == {"a.txt": ("text", "plain ü"), "b.pdf": ("pdf", None), "c.docx": ("docx", None), "d.docx": ("docx", "One two\nThree")}
    parts = files.byte_chunks(spark, str(d / "c.docx"), 4).orderBy("chunk").collect()
    assert [bytes(r.bytes) for r in parts] == [b"not ", b"a zi", b"p"]
    tries = []
    with pytest.raises(ValueError):
        files.load_checked(lambda: tries.append(1) or spark.range(3), lambda df: False, attempts=2, wait=0.01)
    assert len(tries) == 2 and files.load_checked(lambda: spark.range(3), lambda df: False, attempts=1, skip=True) is None
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "x"}\n')
    df, failed = files.load_files(spark, [str(tmp_path / "x.jsonl"), str(tmp_path / "none.jsonl")], wait=0.01)
    assert df.count() == 1 and failed == [str(tmp_path / "none.jsonl")]
    (tmp_path / "g.jsonl").write_text('{"id": "1", "citations": ["2", "9"], "references": ["1"]}\n{"id": "2", "references": ["1", "1"]}\n')
    nodes, edges = files.graph_from_jsonl(spark, str(tmp_path / "g.jsonl"))
    assert nodes.count() == 2 and {tuple(r) for r in edges.collect()} == {("1", "2", "cites"), ("2", "1", "refers")}


def test_collected_stream_is_not_held_by_the_driver(spark, tmp_path):
    """Rows of a stream lie in files, in complete mode those of the last batch, in append mode those of every batch."""
    e = spark.sql("select id as event_id, concat('u', id) as user, timestamp_ntz'2024-01-01 00:00:00' as ts, 1.0d as value from range(4)")
    e.repartition(2, "event_id").write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), e.schema)
    sessions = S.collected(S.sessions(stream, "10 minutes", "1 hour", "user", "value"), "whole", "complete", str(tmp_path / "c"))
    ids = S.collected(stream.select("event_id"), "ids", "append", str(tmp_path / "d"))
    assert sorted(r.user for r in sessions.collect()) == ["u0", "u1", "u2", "u3"] and sorted(r.event_id for r in ids.collect()) == [0, 1, 2, 3]
    assert sessions.inputFiles() and ids.inputFiles() and not spark.catalog.tableExists("whole")
