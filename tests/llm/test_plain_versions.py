"""Features, disclosing terms, url verdicts and near-duplicate recall against plain Python; pipeline stages on odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from lumenquarry.llm import near_dedup, pii, q_near, q_pii, q_toxic, q_url, toxicity, url_filter
from test_text_models import ODD, base  # the same folder

SF = "/root/testdata/sf0.001"


def plain_features(text, odds):
    """Every feature by its meaning, in the order of toxicity.NAMES."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    n, chars = max(1, len(words)), max(1, len(text))
    value = lambda w: max((odds.get(u, 0.0) for u in toxicity.units(w)), default=0.0)
    strong = [value(w) for w in words if value(w) > 0]
    marked = [i for i, w in enumerate(words) if value(w) > 0 or w in toxicity.INSULTS]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    capitals = re.findall("[A-ZÀ-ÖØ-Þ]+", text)
    leet = [w for w in text.split() if not w.isalpha() and re.search(r"[A-Za-z][0-9@$!]+[A-Za-z]|[0-9@$]+[A-Za-z]{2}", w)]
    unfold = dict(zip("013457@$!", "oieastasi", strict=True))
    folded = [p for w in leet for p in re.findall(r"[^\W\d_]+", "".join(unfold.get(c, c) for c in w.lower()))]
    insults = [w for w in words if w in toxicity.INSULTS]
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñíóú"
    return [
        len(insults) / n, len(insults), len(strong) / n, len(strong), sum(strong), max(strong, default=0.0),
        len({w for w in words if value(w) > 0}), sum(v > 3 for v in strong) / n, len(second) / n,
        sum(any(abs(i - j) <= 4 for j in marked) for i in second), sum(map(len, capitals)) / chars, sum(len(c) > 2 for c in capitals),
        text.count("!"), text.count("?"), len(re.findall(r"[^\w\s]", text)) / chars, len(re.findall("[0-9]", text)) / chars,
        len(leet) / n, len(re.findall(r"\b(?:\w[ .*_-]){3,}\w\b", text)), sum(low.count(c * 3) for c in letters) / n,
        len(re.findall(r"\w[*#@$%]{2,}\w?", text)) / n, sum(w in toxicity.INSULTS or odds.get(w, 0.0) > 3 for w in folded),
        math.log1p(len(words)), chars / n,
    ]


def test_features_equal_plain(spark):
    odds = {"idiot": 4.0, "hass-": 2.0, "river": 1.6, "wretch": 3.5}
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", "YOU wr3tch!!! du i d i o t haaassen sh**t 1d10t?", "Hassen " * 3000, "ÀÉ you river 5t0ne"]
    for t in texts:
        got = toxicity.features(t, toxicity.Lexicon(odds))
        assert len(got) == len(toxicity.NAMES)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(got, plain_features(t, odds), strict=True)), t[:80]


def plain_terms(texts):
    """Disclosing words and their posterior, by counting."""
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    words = lambda t: {w for w in regex.split(r"\P{L}+", low(t)) if len(w) >= pii.LETTERS}
    holds_word, holds, own = defaultdict(list), defaultdict(list), {}
    for i, t in enumerate(texts):
        for w in words(t):
            holds_word[w].append(i)
        for e in {(k, t[s:e]) for k, s, e in base(t)}:
            holds[e].append(i)
            own[e] = words(e[1])
    out = {}
    for e, rows in holds.items():
        both = Counter(w for i in rows for w in words(texts[i]) - own[e])
        for w, n in both.items():
            different = len({texts[i] for i in rows if w in words(texts[i])})
            posterior = n / len(holds_word[w])
            if different >= pii.SUPPORT and posterior >= pii.POSTERIOR and math.log2(posterior) - math.log2(len(rows) / len(texts)) >= pii.BITS:
                out[w] = max(out.get(w, 0.0), posterior)
    return out


def plain_spans(text, terms):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    spans = base(text)
    there = sorted(t for t in terms if t in low)
    if there:
        found = regex.finditer(r"(?<!\p{L})(?:" + "|".join(there) + r")(?!\p{L})", low)
        spans += [("term", *m.span()) for m in found if not any(s < m.end() and m.start() < e for _, s, e in base(text))]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_pii_query_equals_plain(spark, tmp_path):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["window", "river", "stone", "Österreich", "cloud"]) for _ in range(n))
    made = [f"Projekt Zanzibarian {say(4)} boss@secret.example.com {say(60)} n{i}" for i in range(4)]
    made += [f"{say(60)} zanzibarian {say(3)}", f"kestrel {say(3)} +49 170 1234567", f"{say(9)} kestrel +49 170 1234567 a", f"kestrel {say(30)}", *[t or "" for t in ODD]]
    docs |= {10**6 + i: t for i, t in enumerate(made)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = plain_terms(list(docs.values()))
    assert {"zanzibarian", "kestrel"} <= terms.keys()
    for r in q_pii.query(spark, str(tmp_path)).collect():
        assert r.spans == plain_spans(docs[r.doc_id], terms), r.doc_id


def plain_verdicts(pages):
    """host, path and verdict of each url that no rule fits: Viterbi by trying every split, then counts."""
    tags = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S | re.I)
    counts = Counter(w.decode() for p in pages for w in re.findall(rb"[a-z]{2,24}", tags.sub(b" ", (p.html or "").encode()).lower()))
    total = sum(counts.values()) or 1

    def cost(w):
        return math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)

    def split(run):
        best = [(0.0, [])]
        for end in range(1, len(run) + 1):
            best.append(max(((best[at][0] + cost(run[at:end]), at) for at in range(max(0, end - 24), end)), key=lambda x: x) )
            score, at = best[end]
            best[end] = (score, best[at][1] + [run[at:end]])
        return best[-1][1]

    def tokens(host, path):
        return [m + ("0" if p.isdigit() else w) for m, s in (("h:", host), ("p:", path.lower())) for p in re.findall(r"[a-z]+|[0-9]+|[^\W\d_]+", s) for w in ([p] if p.isdigit() else split(p))]

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]

    rule = lambda h, p: max((x for x in q_url.RULES if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)), key=lambda x: len(x.text), default=None)
    rows = [(p.page_id, *parts(p.url)) for p in pages]
    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    for _, h, p in rows:
        if r := rule(h, p):
            seen[r.verdict].update(tokens(h, p))
            n[r.verdict] += 1
    kinds = len(seen["allow"] | seen["block"])
    out = {}
    for i, h, p in rows:
        if r := rule(h, p):
            out[i] = (h, p, r.verdict, None)
            continue
        odds = math.log((n["block"] + 1) / (n["allow"] + 1))
        for t in tokens(h, p):
            if seen["allow"][t] + seen["block"][t]:
                odds += math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + kinds + 1)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + kinds + 1))
        out[i] = (h, p, "block" if odds > 0 else "allow", odds)
    return out


def test_url_query_equals_plain(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = plain_verdicts(pages)
    got = q_url.query(spark, sf).collect()
    assert len(got) == len(pages) and {v[2] for v in want.values()} == {"allow", "block"}
    for r in got:
        host, path, verdict, odds = want[r.page_id]
        assert (r.host, r.path) == (host, path)
        assert r.verdict == verdict or abs(odds) < 1e-9


def test_url_long_html(spark):
    """Pages without ends of tags and very long urls take time in proportion to their length."""
    rng = random.Random(2)
    for _ in range(3000):
        h = b"".join(rng.choice([b"<script", b"</script>", b"<STYLE>", b"</Style>", b"<", b">", b" ab ", b"cd", b"<p>", b"</p"]) for _ in range(rng.randint(0, 12)))
        assert url_filter.visible(h).split() == url_filter._TAGS.sub(b" ", h).lower().split()
    began = time.perf_counter()
    for h in (b"<script " * 100_000, b"<" * 800_000, b"<p " * 200_000 + b">", b"</script>" + b"<script>" * 100_000):
        url_filter.visible(h)
    assert time.perf_counter() - began < 5
    rows = [(1, "http://a.org/" + "x" * 3000, "<script " * 30_000), (2, "http://" + "casino" * 40 + ".org", "<" * 200_000), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id for r in url_filter.judge(pages, q_url.RULES).collect()} == {1, 2, 3}


def test_near_query_recall(spark):
    """On the smallest table the query is exact; at sf0.1 the links of every document whose id 20 divides are found."""
    from test_near_dedup import brute

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute([t for _, t in docs], 2)
    got = {r.doc_id: r for r in q_near.query(spark, SF).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i, _ in docs] == [(n, docs[k][0]) for n, k in want]
    sf = "/root/testdata/sf0.1"
    sets = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    component = {r.doc_id: r.component_id for r in q_near.query(spark, sf).collect()}
    links = found = 0
    for i in (i for i in sets if i % 20 == 0):
        common = Counter(j for x in sets[i] for j in holders[x])
        for j, n in common.items():
            if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                links, found = links + 1, found + (component[i] == component[j])
    print("links", links, "found", found)
    assert links > 50 and found == links


def test_clashing_columns(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(1, text, 0, 1, "k"), (2, text + " end", 1, 2, "k"), (3, None, 1, 3, None), (4, "", 0, 4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, __id long, __key string")
    labels = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 1, 6)], "doc_id long, quality int, toxic int, __id int")
    model = toxicity.fit(docs, labels, F.lit(False))
    assert toxicity.without_toxic(docs, model, 1.1).columns == docs.columns
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4}


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, kind):
    """Nulls in every column, empty and very long texts, repeated rows and columns of the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, row string, label int, __key long, node long"
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [None, "", "same text here", "same text here", "\n \t", long, long + " more", "kurz", "Ünïcode 日本 text"] * 3
    rows = [(i, t, None, [None, "a", "b"][i % 3], None, 1, 2, "r", i % 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "orphan text", None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows if kind == "odd" else [], schema)
    spark.createDataFrame([(2, 1, 0), (5, 0, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == docs.columns, name
        before, now = docs.collect(), after.collect()
        if name == "exact_dedup":
            assert Counter(r.text or "" for r in now) == Counter({r.text or "" for r in before})
        if name == "near_dedup":
            longest = [r for r in before if r.text and len(r.text) > 10**5]
            assert len(now) == len(before) - max(0, len(longest) - 1)
        if name == "mixing":
            assert {r.doc_id for r in now if not (r.text or "").split()} == {r.doc_id for r in before if not (r.text or "").split()}
        if name == "packing":
            assert {r.doc_id for r in now} == {r.doc_id for r in before}
        docs = after


def test_toxic_query_is_deterministic(spark):
    a, b = (hashlib.sha256(str(sorted(map(tuple, q_toxic.query(spark, SF).collect()), key=str)).encode()).hexdigest() for _ in range(2))
    assert a == b
