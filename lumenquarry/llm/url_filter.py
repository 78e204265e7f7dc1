"""URL filters: rules first, then naive Bayes on words that a unigram Viterbi search splits out of host and path.

Word counts come from the texts of all pages. The rules label the pages they fit; those train the classifier,
which judges the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import cut, in_slices, ship_package

#: Words and classifier tokens that are broadcast, at most: the commonest. The rest are looked up by a join.
WORDS, TOKENS = 200_000, 200_000
LONGEST_WORD = 24
#: Bits of a sketch of the other words (2 MB), which spares most joins; how full it is changes no result.
SKETCH_BITS = 1 << 24

_TAGS = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
_LETTERS = re.compile(rb"[a-z]{2,%d}" % LONGEST_WORD)
_PIECES = re.compile(r"[a-z]+|[0-9]+|[^\W\d_]+")


SEEN = "array<struct<t:string,n:bigint,b:bigint>>"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty where the url is null or has no "://"."""
    pattern = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (text, verdict) of the longest rule whose host is the url's or above it and whose path begins its path."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def visible(html: bytes) -> bytes:
    """The html without scripts, styles and tags, in lower case.

    Scripts are looked for up to the last end of one, tags up to the last ">", so no start is followed to the end in vain.
    """
    low = html.lower()
    cut_at = max(low.rfind(b"</script>") + 9, low.rfind(b"</style>") + 8)
    cut_at = cut_at if cut_at > 8 else 0
    last = max(cut_at, low.rfind(b">") + 1)
    return _TAGS.sub(b" ", low[:cut_at]) + _TAG.sub(b" ", low[cut_at:last]) + low[last:]


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """Rows (word, c) over the visible texts of all pages."""

    def run(batches):
        held: Counter = Counter()
        for batch in in_slices(batches):
            for html in batch.column(0).to_pylist():
                held.update(_LETTERS.findall(visible(html)))
            if len(held) > 300_000:
                yield _rows(held)
                held.clear()
        if held:
            yield _rows(held)

    def _rows(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html")
    return pages.select(html).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Segmenter:
    """Splits runs of letters into the most probable words; unknown ones cost more the longer they are."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) or 1
        self.logs = {w: log(c / self.total) for w, c in counts.items()}
        self.memo: dict[str, list[str]] = {}

    def _cost(self, word: str, more: dict[str, int]) -> float:
        known = self.logs.get(word)
        if known is None and word in more:
            known = log(more[word] / self.total)
        return known if known is not None else log(10.0 / self.total) - len(word) * log(10.0)

    def words(self, run: str, more: dict[str, int] | None = None) -> list[str]:
        """more: counts of words of the run that aren't among the broadcast ones."""
        more = {w: c for w, c in more.items() if w in run} if more else {}
        found = None if more else self.memo.get(run)
        if found is None:
            best: list[tuple[float, int]] = [(0.0, 0)]
            for end in range(1, len(run) + 1):
                best.append(max((best[at][0] + self._cost(run[at:end], more), at) for at in range(max(0, end - LONGEST_WORD), end)))
            found, end = [], len(run)
            while end:
                found.append(run[best[end][1] : end])
                end = best[end][1]
            found.reverse()
            if len(self.memo) > 100_000:
                self.memo.clear()
            if not more:
                self.memo[run] = found
        return found

    def unknown(self, host: str, path: str) -> set[str]:
        """Parts of the letter runs of host and path that may be words and aren't among the broadcast ones."""
        runs = {r for r in _PIECES.findall(host) + _PIECES.findall(path.lower()) if not r.isdigit()}
        subs = {r[at:end] for r in runs for at in range(len(r)) for end in range(at + 2, min(len(r), at + LONGEST_WORD) + 1)}
        return {w for w in subs if w not in self.logs}

    def tokens(self, host: str, path: str, more: dict[str, int] | None = None) -> list[str]:
        """Words of the host (h:) and of the path (p:); a number is one token."""
        out = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for piece in _PIECES.findall(text):
                out += [mark + "0"] if piece.isdigit() else [mark + w for w in self.words(piece, more)]
        return out


class NaiveBayes:
    """Multinomial, add-one; classes allow and block. totals: kinds of tokens and tokens of each class, if not all are in counts."""

    def __init__(self, counts: dict[str, tuple[int, int]], pages: tuple[int, int], totals: tuple[int, int, int] | None = None):
        kinds, *sums = totals or (len(counts), *(sum(c[k] for c in counts.values()) for k in (0, 1)))
        self.sums = [n + kinds + 1 for n in sums]
        self.prior = log((pages[1] + 1) / (pages[0] + 1))
        self.logs = {t: self.log_odds(*c) for t, c in counts.items()}

    def log_odds(self, allowed: int, blocked: int) -> float:
        return log((blocked + 1) / self.sums[1]) - log((allowed + 1) / self.sums[0])

    def blocks(self, tokens: list[str], more: dict[str, float] | None = None) -> bool:
        """True if block is likelier; a tie allows. Tokens never seen in training say nothing."""
        more = more or {}
        return self.prior + sum(self.logs.get(t, more.get(t, 0.0)) for t in tokens) > 0


def _beyond(counts: DataFrame, common: list, n: str, key: str) -> DataFrame:
    """The rows after the commonest ones in order of falling n, then key."""
    last = common[-1]
    return counts.where((F.col(n) < last[n]) | ((F.col(n) == last[n]) & (F.col(key) > last[key])))


def _sketch(words: DataFrame) -> bytes:
    """Bits of the hashes of words; the driver gets SKETCH_BITS."""
    at = F.pmod(F.xxhash64("word"), F.lit(SKETCH_BITS))
    parts = words.select(F.floor(at / 65536).cast("int").alias("part"), (at % 65536).cast("int").alias("bit"))
    out = bytearray(SKETCH_BITS // 8)

    def run(key, t):
        bits = np.zeros(65536, bool)
        bits[t.column("bit").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    for r in parts.groupBy("part").applyInArrow(run, "part int, bits binary").toLocalIterator():
        out[r["part"] * 8192 : (r["part"] + 1) * 8192] = r["bits"]
    return bytes(out)


def _with_rare(rows: DataFrame, asked, columns: list[str], rare: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """Add an array `name` of (key, *values) from rare: those that asked(...) lists for a row's columns."""

    def run(batches):
        for batch in in_slices(batches, 1000):
            lists = [asked(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for x in lists for w in x], pa.string())], ["row", key])

    found = rows.select("row", *columns).mapInArrow(run, f"row long, {key} string").join(rare.select(key, *values), key)
    found = found.groupBy("row").agg(F.collect_list(F.struct(key, *values)).alias(name))
    return rows.join(found, "row", "left")


def _dict(words: list | None) -> dict[str, int] | None:
    return {x["word"]: x["c"] for x in words} if words else None


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    Without pages that a rule fits the classifier allows. A null or malformed url has empty host and path and is
    the classifier's to judge; a null html has no words. Repeated rows are judged alike. Empty table: empty result.
    """
    spark = pages.sparkSession
    ship_package(spark)
    counts = cut(word_counts(pages, html_col))
    n_words, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    common = list(counts.orderBy(F.desc("c"), "word").limit(WORDS).toLocalIterator())
    told = spark.sparkContext.broadcast(Segmenter({r["word"]: r["c"] for r in common}, total))
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"words": F.lit(None).cast("array<struct<word:string,c:bigint>>"), "seen": F.lit(None).cast(SEEN)})
    if n_words > WORDS:
        rare = _beyond(counts, common, "c", "word")
        sketch = spark.sparkContext.broadcast(_sketch(rare))

        def asked(host, path):
            bits = sketch.value
            at = {w: xxhash.xxh64_intdigest(w.encode(), 42) % SKETCH_BITS for w in told.value.unknown(host, path)}
            return [w for w, i in at.items() if bits[i >> 3] >> (i & 7) & 1]

        rows = cut(rows.drop("words").withColumn("row", F.monotonically_increasing_id()))
        rows = cut(_with_rare(rows, asked, ["host", "path"], rare, "word", ["c"], "words"))

    def split(batches):
        for batch in in_slices(batches, 1000):
            hosts, paths, words = (batch.column(i).to_pylist() for i in (1, 2, 3))
            tokens = [told.value.tokens(h, p, _dict(w)) for h, p, w in zip(hosts, paths, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["label", "tokens"])

    labelled = rows.where("rule is not null").select((F.col("rule.verdict") == "block").cast("int").alias("label"), "host", "path", "words")
    labelled = cut(labelled.mapInArrow(split, "label int, tokens array<string>"))
    blocked = F.sum("label").cast("long")
    n, n_blocked = labelled.agg(F.count("*"), F.coalesce(blocked, F.lit(0))).first()
    seen = labelled.select("label", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), blocked.alias("b"))
    seen = cut(seen)
    zero = F.lit(0)
    kinds, n_tokens, b_tokens = seen.agg(F.count("*"), F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("b"), zero)).first()
    common = list(seen.orderBy(F.desc("n"), "t").limit(TOKENS).toLocalIterator())
    bayes = NaiveBayes({r["t"]: (r["n"] - r["b"], r["b"]) for r in common}, (n - n_blocked, n_blocked), (kinds, n_tokens - b_tokens, b_tokens))
    model = spark.sparkContext.broadcast(bayes)
    if kinds > TOKENS:

        def unseen(host, path, words, rule):
            return [] if rule else {t for t in told.value.tokens(host, path, _dict(words)) if t not in model.value.logs}

        if "row" not in rows.columns:
            rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = cut(rows.withColumn("by_rule", F.col("rule.verdict")).drop("seen"))
        rows = _with_rare(rows, unseen, ["host", "path", "words", "by_rule"], _beyond(seen, common, "n", "t"), "t", ["n", "b"], "seen")

    def decide(batches):
        for batch in in_slices(batches, 1000):
            hosts, paths, told_by_rule, words, odds = (batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6))
            more = [{x["t"]: model.value.log_odds(x["n"] - x["b"], x["b"]) for x in s or ()} for s in odds]
            verdict = [
                r or ("block" if model.value.blocks(told.value.tokens(h, p, _dict(w)), m) else "allow")
                for r, h, p, w, m in zip(told_by_rule, hosts, paths, words, more, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    rows = rows.select("id", "host", "path", F.col("rule.text").alias("rule"), F.col("rule.verdict").alias("by_rule"), "words", "seen")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(decide, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
