"""Personal data, url filters, LM scores and toxicity against plain Python; the pipeline end to end."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lumenquarry.llm import lm_scoring, pii, q_lm, q_pii, q_toxic, q_url, toxicity, url_filter
from lumenquarry.llm.boosting import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.001"


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


ODD = [
    "a@b.c_d@e.f x@y a.b@c-d.e-f.gh. @a.b ..@..  é34@mail7.example.com",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004 256.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110 5500005555555559 4111  1111",
    "+1 (377) 555-0271 +4930123456 +1-2 +123456789012345678 +49 ((( 12",
    "", None, "1" * 3000, "a" * 20000 + "@", "x@" + "y." * 2000 + "z", "日本 a@b.co 語 1.1.1.1 \n +49 170 1234567",
]


def test_pii_base(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ODD[0]), (None, ODD[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("key", F.lit("k"))
    got = pii.find(docs).select("doc_id", "text", pii.listed(F.col("spans")).alias("s")).collect()
    assert Counter((r.doc_id, r.s) for r in got) == Counter((i, ",".join(f"{k}:{s}:{e}" for k, s, e in base(t or ""))) for i, t in rows)
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_terms(spark):
    rng = random.Random(1)
    common = ["window", "river", "stone", "cloud"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{say(5)} zanzibarian {say(1)} boss@secret.example.com {say(3)} v{i}" for i in range(5)]
    texts += [f"{say(8)} Zanzibarian, {say(4)}", *[say(12) for _ in range(100)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).select("*", pii.sanitised(F.col("text"), F.col("spans"), F.col("removed")).alias("safe")).collect()}
    terms = lambda r: [s["value"] for s in r.spans if s["kind"] == 4]
    assert all(terms(got[i]) == ["zanzibarian"] for i in range(6))
    assert not any(terms(got[i]) for i in range(6, len(texts)))
    assert all("boss@" not in r.safe and "anzibar" not in r.safe for r in got.values())
    span = next(s for s in got[5].spans)
    assert texts[5][span["start"] : span["end"]] == "Zanzibarian"


def test_pii_terms_far_away(spark):
    """A name in the heading discloses the address in the footer, as near the mention as far from it."""
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["window", "river", "stone", "cloud"]) for _ in range(n))
    gap = lambda i: say(60 if i % 3 else 2)
    texts = [f"Zanzibarian report. {say(60)} boss@secret.example.com v{i}" for i in range(5)]
    texts += [f"quillfeather {gap(i)} +49 170 7654321 {say(3)} n{i}" for i in range(6)]
    texts += [texts[0], *[say(12) for _ in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s["value"] for s in r.spans if s["kind"] == 4} for r in pii.find(docs).collect()}
    assert all(got[i] == {"zanzibarian", "report"} for i in (*range(5), 11))
    assert all(got[i] == {"quillfeather"} for i in range(5, 11))
    assert not any(got[i] for i in range(12, len(texts)))


def test_pii_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in q_pii.query(spark, SF).collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base(docs[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "http://x.net/es/", "ftp://h.org", "no scheme", None, "", "a://b://c/d", "http://net/fr/", "http://xnet/fr/", "http://example.com", "http://h.com?x=/en/"]
    rows = [(i, u, None if i % 3 else "<p>free bets casino win</p>" * 3) for i, u in enumerate(urls)] + [(0, urls[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    got = url_filter.judge(pages, q_url.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(urls[r.page_id])
        fits = [x for x in q_url.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.text)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), q_url.RULES).count() == 0


def test_url_rare_words_and_tokens(spark, monkeypatch):
    """Words and tokens beyond the broadcast ones count all the same."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(400):
        a, b = rng.choice(names[: 30 + i % 30]), rng.choice(names)
        url = f"http://{a}{b}.{'net/es/' if names.index(a) % 2 else 'example.com/en/'}{b}" if i % 2 else f"http://{a}{b}.org/{b}{a}"
        rows.append((10_000 + i, url, f"<p>{a} {b} {a}</p>"))
    pages = pages.limit(100).unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    rules = [*q_url.RULES[3:], url_filter.Rule("example.com", "/en/", "allow")]
    found = []
    for most in (200_000, 20):
        monkeypatch.setattr(url_filter, "WORDS", most)
        monkeypatch.setattr(url_filter, "TOKENS", most)
        found.append(sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages, rules).collect()))
    assert {r[4] for r in found[0] if not r[3]} == {"allow", "block"}
    assert found[0] == found[1]


def test_segmentation():
    s = url_filter.Segmenter({"casino": 50, "win": 80, "free": 90, "bets": 40, "the": 500, "be": 300})
    assert s.words("freebetscasinowin") == ["free", "bets", "casino", "win"]
    assert s.tokens("m.casino-win.org", "/en/77") == ["h:m", "h:casino", "h:win", *["h:" + w for w in s.words("org")], *["p:" + w for w in s.words("en")], "p:0"]


def level(c):
    return 1 + math.floor(math.log2(c) * lm_scoring.STEPS + 1e-9)


def middle(c):
    """The middle of the counts that share a level with c."""
    if not c:
        return 0.0
    same = [k for k in range(max(1, c // 2), 2 * c + 2) if level(k) == level(c)]
    return (same[0] + same[-1]) / 2


def plain_scores(texts, learns):
    """(n_tokens, n_known, N, base, score) of each text: the model without a filter."""
    docs = [(t or "").encode().lower().split() + [None] for t in texts]
    one, two = Counter(), Counter()
    for ws, learn in zip(docs, learns, strict=True):
        if learn:
            one.update(ws)
            two.update(zip([None, *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    floor, memo, out = n + 0.1 * (v + 1), {}, []
    near = lambda c: memo.setdefault(c, middle(c))
    for ws in docs:
        score = 0.0
        for before, w in zip([None, *ws], ws, strict=False):
            p, context = (near(one[w]) + 0.1) / floor, near(one[before])
            if context:
                p = lm_scoring.WEIGHT * min(1.0, near(two[before, w]) / max(context, 1.0)) + (1 - lm_scoring.WEIGHT) * p
            score += math.log10(p)
        out.append((len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10((one[w] + 0.1) / floor) for w in ws), score))
    return out


def test_lm_query_equals_plain(spark, monkeypatch):
    """Counts and base scores are exact; with bits enough for no false positive the scores are those of exact counts.

    The ways of looking up (broadcast, by part) and the sizes of chunks and parts change nothing.
    """
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = [r.doc_id for r in rows]
    learns = [zlib.crc32(str(i).encode()) % 10 != 0 for i in ids]
    want = dict(zip(ids, plain_scores([r.text for r in rows], learns), strict=True))
    found = []
    for broadcast, part, chunk in ((1 << 24, 1 << 24, 1 << 19), (0, 1 << 17, 20_000), (1 << 24, 1 << 17, 20_000)):
        monkeypatch.setattr(lm_scoring, "BROADCAST_BYTES", broadcast)
        monkeypatch.setattr(lm_scoring, "PART_BYTES", part)
        monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
        exact = lm_scoring.score_documents(docs, held_out, bits_per_entry=400).collect()
        assert len(exact) == len(rows)
        for r in exact:
            n, known, total, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        got = q_lm.query(spark, SF).collect()
        assert all(math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) for r in got)
        off = [abs(r.score - want[r.doc_id][4]) / r.n_tokens for r in got]
        assert max(off) < 0.2 and np.mean(off) < 0.02  # false positives
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs help on texts not learned from
        found.append({r.doc_id: r.score for r in got})
    assert all(math.isclose(found[1][i], found[2][i], rel_tol=1e-9) for i in ids)


def test_lm_filter_counts():
    rng = np.random.default_rng(0)
    h, c = rng.integers(0, 2**63, 3000, np.uint64), np.maximum(1, rng.pareto(1.0, 3000) * 2).astype(np.int64)
    lm = lm_scoring.LogFrequencyFilter.filled(h, c)
    seen, exact = lm.levels(h), lm_scoring.level_of(c)
    assert (seen >= exact).all() and (seen == exact).mean() > 0.97
    assert (lm.levels(rng.integers(0, 2**63, 4000, np.uint64)) == 0).mean() > 0.98
    counts = np.arange(1, 300)
    assert np.allclose(lm_scoring.count_of(lm_scoring.level_of(counts)), [middle(int(k)) for k in counts])
    s = np.sort(h)
    assert (lm_scoring._hashes(lm_scoring._gaps(s)) == s).all() and (lm_scoring._spread(lm_scoring._squeezed(c)) == c).all()


def test_lm_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, "a b a"), (2, "a b a"), (None, "A B"), (3, "c " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = lm_scoring.score_documents(docs, F.col("doc_id") == 3).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens) for r in got) == sorted([("1", False, 1), ("1", False, 1), ("2", False, 4), ("2", False, 4), ("None", True, 3), ("3", True, 4001)])
    assert lm_scoring.score_documents(docs.limit(0), F.col("doc_id") == 3).count() == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees(rounds=30).fit(x[:2000], y[:2000])
    margin = trees.margin(x)
    assert ((margin[2000:] > 0) == y[2000:]).mean() > 0.93
    p = Isotonic(margin[:2000], y[:2000])(np.sort(margin))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1
    assert BoostedTrees().fit(np.empty((0, 2)), np.empty(0)).margin(np.zeros((3, 2))).shape == (3,)


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = q_toxic.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in good] for a in bad]) > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.05


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "YOU IDIOT!!! " * 3000), (3, "nice day"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (3, 1, 1), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = toxicity.fit(docs, labels, F.lit(False))
        got = toxicity.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.without_toxic(docs, model, 1.1).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[4] > counts[3]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    first = spark.read.parquet(f"{tmp_path}/toxicity")
    assert first.count() > 0.8 * counts[0] and toxic
    assert corpus_pipeline.run(spark, SF).count() == counts[5]
