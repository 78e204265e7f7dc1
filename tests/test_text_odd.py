"""Text queries on odd rows against DuckDB's patterns, whose word bounds are ASCII."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenquarry.plans.catalog import QUERIES, SQL

TEXTS = [
    "a@b.co-x@c.org", "..me@x.com", "%+-@x.com", "éa@b.com", "a@b.comé", "a@b.c|9@x.yz", "a@b.com@c.org", "x" * 70 + "@y.de", "." * 80 + "q@r.st", "a@b.c", "_@b.de_", "a@b..com", "a@b.com-é",
    "é0123456789é", "x+989123456789 +989123456789 09123456789 9123456789", "1234 5678-9012\t3456", "1234\x0b567890123456", "1.2.3.4é 1.2.3.4.5 999.1.1.1x", "a1234567890", "٠١٢٣٤٥٦٧٨٩", "", None,
]


def results(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))), sorted(map(repr, want))


@pytest.mark.parametrize("name", ["pii_scrub_values", "pii_is_safe"])
def test_documents(spark, tmp_path, name):
    got, want = results(spark, tmp_path, name, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    assert got == want


@pytest.mark.parametrize("name", ["pii_scrub_values", "pii_is_safe"])
def test_long_texts_take_linear_time(spark, tmp_path, name):
    text = "Some words. " * 1_000_000 + "a@b.com"
    spark.createDataFrame([(1, text), (2, "word" * 1_000_000 + "@")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    QUERIES[name](spark, str(tmp_path)).limit(0).collect()
    began = time.time()
    assert QUERIES[name](spark, str(tmp_path)).agg(F.count("*")).first()[0] in (1, 2)
    assert time.time() - began < 15


def test_safety_takes_one_pass(spark, tmp_path):
    """200 MB of plain texts: the five patterns one after the other took several times as long."""
    text = "Plain words of a text, 12 or 2024, without any of it. " * 40
    spark.range(100_000, numPartitions=8).selectExpr("id as doc_id", f"concat('{text}', if(id = 7, '1.2.3.4', '')) as text").write.parquet(f"{tmp_path}/documents.parquet")
    QUERIES["pii_is_safe"](spark, str(tmp_path)).where("doc_id = 7").collect()
    began = time.time()
    assert [r.doc_id for r in QUERIES["pii_is_safe"](spark, str(tmp_path)).where("not safe").collect()] == [7]
    assert time.time() - began < 15


def test_sentences_on_odd_rows(spark, tmp_path):
    texts = ["A. B", "A.\x0bB", "A.\u00a0B", "\u3000A. \u00a0 B!\u2003", "A\x01B. C", "A.  \t\r\n\fB?", "...", ". . .", "\u00a0", "A.\n\u2028B", "é؟ é", "", None]
    got, want = results(spark, tmp_path, "text_sentence_split", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want


def test_intent_on_odd_rows(spark, tmp_path):
    texts = ["éthe", "theé x", "ofé", "quel que", "éla", "The", "_of", "a-die-b", "of1", "dasß", "le\u0301", "", None]
    got, want = results(spark, tmp_path, "query_intent", "benchmark", list(enumerate(texts)), "item_id long, text string")
    assert got == want


def test_threats_at_exactly_three_deviations(spark, tmp_path):
    """Nine equal days and a busier one: the distance is three deviations whatever the counts, so not above it; eleven days are."""
    rows = [(u, d, n + (k if d == 4 else 0)) for u, (n, k) in enumerate((n, k) for n in range(1, 13) for k in range(1, 9)) for d in range(10)]
    rows += [(1000, d, 9 if d == 4 else 2) for d in range(11)]
    days = spark.createDataFrame(rows, "user_id long, d int, n int")
    e = days.selectExpr("user_id", "cast(timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, d) as timestamp_ntz) as ts", "explode(sequence(1, n)) as event_id", "'view' as event_type")
    e.write.parquet(f"{tmp_path}/events.parquet")
    high = QUERIES["actor_threats"](spark, str(tmp_path)).where("threat = 'high'").collect()
    assert [(r.user_id, r.n) for r in high] == [(1000, 9)]
