"""Exact dedup, sharding, mixing, packing and fingerprints against plain Python, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenquarry.llm import exact_dedup, fingerprints, mixing, packing, q_exact, q_mix, q_pack, q_print, q_shard, sharding, wordbpe
from lumenquarry.llm.q_pack import tokenizer_path

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string"


def odd_docs(spark, seed=0, n=120):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like outputs."""
    rng = random.Random(seed)
    words = ["alpha", "beta.", "Gamma", "naïve", "日本", "x", "a|b", "don't"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200])))
        rows.append((i, rng.choice([text, text, None, "", "same text\nhere"]), None, rng.choice(["b", "a", None, "hot", "hot", "hot"]), len(text), 1, 2, "r"))
    rows.append((n, "\n\n".join(["long text. " * 3000, "other! part? " * 500]), "en", "a", 0, None, None, None))
    rows += [rows[3], rows[3], (None, "orphan", None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    rows, docs = odd_docs(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    pick = min if keep == "min" else max
    want = Counter()
    for text, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        for i in ids:
            want[(i, best if best is not None else i, len(ids), i == best if best is not None else True, hashlib.sha256(text.encode()).hexdigest())] += 1
    for hash_of in (None, lambda c: F.unhex(F.hex(F.length(c) % 3))):  # the second makes texts collide
        got = exact_dedup.exact_duplicates(docs, keep, **({"hash_of": hash_of} if hash_of else {}))
        assert Counter(tuple(r) for r in got.collect()) == want
    kept = exact_dedup.distinct_texts(docs, keep)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert Counter(r.text or "" for r in out) == Counter(groups.keys())
    assert {r.doc_id for r in out} == {pick([i for i in ids if i is not None], default=None) for ids in groups.values()}
    assert exact_dedup.exact_duplicates(docs.limit(0), keep).count() == 0


@pytest.mark.parametrize("run", [4096, 3])
def test_sharding(spark, monkeypatch, run):
    monkeypatch.setattr("lumenquarry.llm.common.RUN", run)
    rows, docs = odd_docs(spark, 1, 400)
    got = sharding.shard_documents(docs, [1.0, 1.0, 2.0, 1.0]).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(slots[2]) > 1.4 * np.mean([len(slots[k]) for k in (0, 1, 3)])
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    ids = spark.range(20000)
    moved = ids.select(F.avg((sharding.rendezvous("id", [1.0] * 8) != sharding.rendezvous("id", [1.0] * 9)).cast("double"))).first()[0]
    assert 0.09 < moved < 0.13


def owner(key, weights, seed="shard"):
    """Weighted rendezvous: the shard of the greatest -weight / ln(u), u from 52 bits of an md5."""
    def score(i):
        digest = hashlib.md5(f"{seed}:{i}:{'null' if key is None else key}".encode()).hexdigest()
        return -weights[i] / math.log(int(digest[:13], 16) / 2**52 + 2**-54)

    return max(range(len(weights)), key=lambda i: (score(i), -i))


def test_shard_query_equals_plain(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = defaultdict(list)
    got = q_shard.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (owner(r.doc_id, [1.0] * 8), owner(r.doc_id, [1.0] * 9))
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rows, odd = odd_docs(spark, 8)
    weights = [1.0, 2.5, 0.5]
    assert all(r.shard == owner(r.doc_id, weights) for r in sharding.shard_documents(odd, weights).collect())


def test_pack_query_equals_plain(spark):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = q_pack.query(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fills = defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
    for places in fills.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(places)] == [0, *ends[:-1]]
    assert len(fills) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("module", [q_exact, q_mix])
def test_sql_queries(spark, module):
    """Queries with SQL equal it row by row."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df = module.query(spark, SF)
    columns = sorted(df.columns)
    want = con.sql(module.SQL)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    names = want.columns
    assert sorted(names) == columns
    rows = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows


def fill(sizes, weights, share, epochs):
    """Water-filling by rounds, as the method tells it."""
    total, target, fixed = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = rest * weights[i] / w
        over = {i for i in open_ if target[i] >= epochs * sizes[i]}
        fixed |= over
        for i in over:
            target[i] = epochs * sizes[i]
        if not over or len(fixed) == len(sizes):
            return target


@pytest.mark.parametrize("run", [4096, 3])
def test_mixing(spark, monkeypatch, run):
    monkeypatch.setattr("lumenquarry.llm.common.RUN", run)
    rows, docs = odd_docs(spark, 2)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(r[1]) for r in rows if r[3] == s) for s in sources]
    want = dict(zip(sources, fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5, 2.0), strict=True))
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    for s, size in zip(sources, sizes, strict=True):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    out = texts.collect()
    assert abs(sum(count(r.text) for r in out) - sum(r.taken for r in got)) == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing(spark):
    rows, docs = odd_docs(spark, 3)
    got = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_local_search_empties_bins():
    capacity = 100
    poor = {((60, 1),): 2, ((40, 1),): 1, ((30, 1), (25, 1)): 1, ((15, 1),): 1}
    better = packing.local_search(poor, capacity)
    total = Counter()
    for b, n in better.items():
        for length, k in b:
            total[length] += n * k
    assert total == Counter({60: 2, 40: 1, 30: 1, 25: 1, 15: 1})
    assert sum(better.values()) == 3
    assert all(packing._fill(b) <= capacity for b in better)
    rng = random.Random(5)
    for _ in range(20):
        sizes = Counter(rng.randint(1, 50) for _ in range(60))
        start = packing.best_fit(sizes, 50)
        end = packing.local_search(start, 50)
        square = lambda bins: sum(n * packing._fill(b) ** 2 for b, n in bins.items())
        assert square(end) >= square(start) and sum(end.values()) <= sum(start.values())


def test_word_table_equals_tokenizer():
    table = wordbpe.WordTable(tokenizer_path())
    texts = ["don't we'll <|endoftext|> <|ENDOFTEXT|> İstanbul ΣΑΣ. été ﬁn ...,, a.b,c 12th 日本語。 'S \x00 \x1c b", "", "  \n", "x" * 500, "The the THE the. the,"]
    for t in texts:
        assert table.encode(t.encode()) == np.array(table.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def plain_print(text):
    """Fingerprint of a text: root over sections, paragraphs and leaves, then a short hash of each leaf."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tree = [[[sha(x) for x in re.findall(fingerprints.LEAF, p)] for p in s.split("\n")] for s in text.split("\n\n")]
    root = sha("".join(sha("".join(sha("".join(p)) for p in s)) for s in tree))
    return root + ":" + "/".join(";".join(",".join(x[: fingerprints.SHORT] for x in p) for p in s) for s in tree)


def plain_likeness(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = ({k for k in re.split("[,;/]", f.split(":")[1]) if k} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


@pytest.mark.parametrize(("neighbours", "boundaries"), [(20, 1024), (4, 3)])
def test_fingerprint_query_equals_plain(spark, monkeypatch, neighbours, boundaries):
    monkeypatch.setattr(fingerprints, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(fingerprints, "BOUNDARIES", boundaries)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r.doc_id: r for r in q_print.query(spark, SF).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, following, r = docs[i], docs[ids[(k + 1) % len(ids)]], got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        prints = [plain_print(x) for x in (text, edited, following)]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == prints[:2]
        assert abs(r.near_edited - plain_likeness(*prints[:2])) < 1e-9 and abs(r.near_next - plain_likeness(prints[0], prints[2])) < 1e-9


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "NEIGHBOURS", 20)
    rows, docs = odd_docs(spark, 4)
    got = fingerprints.compare_with_edits(docs).collect()
    ordered = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in rows), key=lambda x: (x[0], x[1].encode()))
    edits = Counter()
    for k, (i, t) in enumerate(ordered):
        following, h = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        edits[(i, len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == edits
    texts = dict(ordered)
    by_print = defaultdict(set)
    for r in got:
        by_print[r.fingerprint].add(texts[r.doc_id if r.doc_id is not None else -1])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_print.values())
    assert fingerprints.compare_with_edits(docs.limit(0)).count() == 0
    a, b = "One. Two.\nThree.\n\nFour.", "One. Two.\nTHREE.\n\nFour."
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(*[fingerprints.fingerprint(fingerprints.tree(F.col(c))).alias(c) for c in "ab"])
    assert pair.select(fingerprints.changed_branches(F.col("a"), F.col("b")).alias("x")).first().x == [(0, 1)]


LISTED = "word”, ”. word». »,, …, —. 。, €, °. ™. 😀. हिन्दी, ไทยครับ่. é. q́. İ. ½. ²,, Ⅷ. ⅷ. ٣. ß. ‍. a\xa0. 　. ﬁ. Å. 가. 𑯲. ab𑯲."


def test_word_table_on_odd_ends():
    """Marks after anything but a letter are one run with it; all code points, and a seeded fuzz."""
    table = wordbpe.WordTable(tokenizer_path())
    plain = lambda t: np.array(table.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for t in LISTED.split(" "):
        assert table.encode(t.encode()) == plain(t), t
    rng = random.Random(7)
    chars = LISTED + "abzéñ日本語“«、̇̈က Σσς.,.,.,'s-!19 \t\n"
    for _ in range(30_000):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(1, 12)))
        assert table.encode(t.encode()) == plain(t), ascii(t)
    for c in (*range(0x80, 0x3100), *range(0xA000, 0xD7FF, 7), *range(0xE000, 0x20000, 5)):
        t = f"a{chr(c)}. {chr(c)}, b{chr(c)}b."
        assert table.encode(t.encode()) == plain(t), ascii(t)


def test_words_before_marks_need_no_encoding_of_their_own(monkeypatch):
    """Each word once through the BPE model, whatever marks follow it; before, every word with other marks than . and , was encoded whole."""
    table, calls = wordbpe.WordTable(tokenizer_path()), []
    whole = wordbpe.WordTable._any
    monkeypatch.setattr(wordbpe.WordTable, "_any", lambda self, piece: calls.append(piece) or whole(self, piece))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(400)]
    text = " ".join(w + rng.choice(["$$$", ",###", "!!", "'", ".", ""]) for w in words)
    assert table.encode(text.encode()) == np.array(table.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(calls) <= 10


def test_tasks_of_a_worker_share_the_table(tmp_path):
    path = tmp_path / "words.json"
    path.write_bytes(open(tokenizer_path(), "rb").read())
    table = wordbpe.table_of(str(path))
    assert wordbpe.table_of(str(path)) is table
    path.write_bytes(path.read_bytes() + b"\n")
    assert wordbpe.table_of(str(path)) is not table


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_word_table_on_many_texts(monkeypatch, kind):
    """Blocks of few bytes and a table that is often full, slices, empty and blank texts, bytes that are no UTF-8."""
    monkeypatch.setattr(wordbpe, "TEXT_BYTES", 90)
    monkeypatch.setattr(wordbpe, "TABLE_SIZE", 25)
    table, rng = wordbpe.WordTable(tokenizer_path()), random.Random(13)
    pieces = [*LISTED.split(" "), "abc", "abc$$$", "Abc.", "éa!", "été,,", "İa?", "don't", "a1.", "<|endoftext|>", "<|ENDOFTEXT|>", "x" * 41 + "!", "가나.", "ab", "!"]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\r\n", "\x0b"]).join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(300)]
    raw = [*(t.encode() for t in texts), b"\xff ab\xc3 \xe6\x97 ab.\xfe! c", b"", b"\x00 \x1c", b"y" * 100_000]
    want = [np.array(table.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in raw]
    column = pa.array([b"skipped", *raw], kind)[1:]
    for _ in range(2):
        assert [bytes(x) for x in table.encode_all(column)] == want
    assert list(table.encode_all(column[:0])) == [] and [bytes(x) for x in table.encode_all(pa.array([b"", b" "], kind))] == [b"", b""]


def test_local_search_ends_where_nothing_improves():
    rng = random.Random(11)
    for capacity, low, high in ((60, 15, 40), (100, 25, 64)):
        sizes = Counter(rng.randint(low, high) for _ in range(300))
        end = packing.local_search(packing.best_fit(sizes, capacity), capacity)
        least = -(-sum(k * n for k, n in sizes.items()) // capacity)
        under = [b for b in end if packing._fill(b) < capacity]
        pairs = [(a, b) for a in under for b in under if packing._fill(a) >= packing._fill(b) and (a != b or end[a] > 1)]
        assert sum(end.values()) == least or not any(packing._better(a, b, capacity - packing._fill(a)) for a, b in pairs)
