"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of one- and two-token sequences of the training documents are summed over the whole corpus. A count c is
quantised to level 1 + floor(log2(c) * STEPS); the filter holds the sequence once for each level up to its own.
A reader probes level after level until a miss, so the highest level present tells the count to within a step,
and a false positive can only raise it by one level with the filter's small error rate.

The filter is split by ranges of hashes into parts, each filled by one task, with bits for every entry of every
sequence, so its error rate is the same for any corpus and nothing is left out. Only a small corpus, whose bytes
prove a bound of its filter, has all parts broadcast to the workers. Otherwise the filter is never gathered: each
chunk of documents sends its distinct sequences with their counts to the parts, once; a part sums the counts of
all chunks, fills its bits, probes them for every sequence it was sent and returns the levels to the chunks, with
the exact counts of single tokens. Both ways probe the same bits and give the same scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import cut, ship_package, text_of

#: Levels for a doubling of the count.
STEPS = 2
#: Bits of the filter for each entry, and probes of an entry.
BITS_PER_ENTRY, PROBES = 12, 4
#: Bytes of text whose sequences one part of the filter takes.
PART_BYTES = 1 << 23
#: Tokens and documents of a chunk; a longer document is a chunk of its own.
CHUNK_TOKENS, CHUNK_DOCS = 1 << 20, 1 << 15
#: Most bytes of text whose model is broadcast. A token has two bytes or more with its space, and a sequence of count
#: c at most 1.5 c levels, so the filter has at most 1.5 * BITS_PER_ENTRY bits a byte (36 MB).
BROADCAST_BYTES = 1 << 24
#: Weight of the two-token probability where its context was seen.
WEIGHT = 0.7
ADD = 0.1

NAMES, PACKED = ["id", "held_out", "n_tokens"], ["one", "count", "ranks"]

_END = b"\n"  # white space, so never a token
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(_END))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the tokens of a text: its words, ASCII letters lower-cased, then the end."""
    words = text.lower().split()
    words.append(_END)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; the first of a document follows the end of another."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = _END_HASH
    return _mix(before * _PAIR + h)


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(count) * STEPS + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; level 0 is a miss."""
    low, high = np.ceil(2.0 ** ((level - 1) / STEPS) - 1e-9), np.ceil(2.0 ** (level / STEPS) - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; parts are ranges of hashes in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class LogFrequencyFilter:
    """The bits of one part, and the reader's probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def filled(cls, hashes: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> LogFrequencyFilter:
        """An entry of each hash for every level up to that of its count."""
        levels = level_of(counts)
        out = cls(np.zeros(max(64, -(-int(levels.sum()) * bits_per_entry // 8)), np.uint8))
        bits = np.zeros(8 * len(out.bits), bool)
        for step in range(1, int(levels.max(initial=0)) + 1):
            hashes, levels = hashes[levels >= step], levels[levels >= step]
            for at in out._places(hashes, step):
                bits[at] = True
        out.bits = np.packbits(bits, bitorder="little")
        return out

    def _places(self, hashes: np.ndarray, level: int):
        x = _mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
        step, n = (x >> np.uint64(32)) | np.uint64(1), np.uint64(8 * len(self.bits))
        for i in range(PROBES):
            yield ((x & np.uint64(0xFFFFFFFF)) + step * np.uint64(i)) * _PAIR % n

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level after level until a probe misses."""
        level, alive, step = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 0
        while len(alive):
            step += 1
            hit = np.ones(len(alive), bool)
            for at in self._places(hashes[alive], step):
                hit &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            level[alive] = step
        return level


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed: by byte position, without the positions that are all zero."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8 or 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(x).to_bytes(7, "little") + pa.compress(planes, "zstd", asbytes=True)


def _spread(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:8], "little")
    out = np.zeros((n, 8), np.uint8)
    planes = pa.decompress(b[8:], decompressed_size=width * n, codec="zstd", asbytes=True)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _gaps(sorted_hashes: np.ndarray, unused: int = 0) -> bytes:
    """Sorted hashes whose lowest `unused` bits are 0, as their differences."""
    h = sorted_hashes >> np.uint64(unused)
    return h[:1].tobytes() + _squeezed(np.diff(h, prepend=h[:1])) if len(h) else b""


def _hashes(b: bytes, unused: int = 0) -> np.ndarray:
    return (_spread(b[8:]).cumsum(dtype=np.uint64) + np.frombuffer(b[:8], np.uint64)) << np.uint64(unused) if b else np.empty(0, np.uint64)


def unused_bits(size: int) -> int:
    """Low bits that hashes of pairs do without: 20 more than the bits of the corpus's size in bytes are kept.

    So two of its pairs meet with the same small chance (2**-20 for a pair, at most) in a corpus of any size.
    """
    return max(0, 64 - 20 - max(28, int(size).bit_length()))


class Chunk:
    """Documents in a row: the sorted distinct hashes of their tokens, and where each token is among them.

    Packed, a token is its rank by frequency; the counts tell which hash has a rank.
    """

    def __init__(self, one: bytes, count: bytes, ranks: bytes, n_tokens: list[int]):
        self.n = np.array(n_tokens, np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.one = _hashes(one)
        self.at = np.argsort(-_spread(count).astype(np.int64), kind="stable")[_spread(ranks).astype(np.int64)]

    @staticmethod
    def packed(hs: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
        one, at, count = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        rank = np.empty(len(one), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(one))
        return _gaps(one), _squeezed(count), _squeezed(rank[at])

    def pairs(self, unused: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the pairs, and where each token's is among them."""
        h = pair_hashes(self.one[self.at], self.starts) >> np.uint64(unused) << np.uint64(unused)
        return np.unique(h, return_inverse=True)

    def scored(self, total: int, kinds: int, exact: np.ndarray, one_level: np.ndarray, at_pair: np.ndarray, pair_level: np.ndarray):
        """n_known, base_score and score of each document, from what was looked up for its tokens and pairs."""
        floor = total + ADD * (kinds + 1)
        base = np.log10(exact + ADD) - np.log10(floor)
        near = count_of(one_level)
        context = np.empty(len(self.at), np.float64)
        context[1:] = near[self.at[:-1]]
        context[self.starts] = near[np.searchsorted(self.one, _END_HASH)]
        single = ((near + ADD) / floor)[self.at]
        ratio = np.minimum(1.0, count_of(pair_level)[at_pair] / np.maximum(context, 1.0))
        p = np.where(context > 0, WEIGHT * ratio + (1 - WEIGHT) * single, single)
        of = lambda x: np.add.reduceat(x, self.starts)
        return of((exact > 0)[self.at].astype(np.int64)), of(base[self.at]), of(np.log10(p))


def _chunks(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (chunk, docs, one, count, ranks): whole documents, about CHUNK_TOKENS tokens together."""

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            n = pa.array([len(h) for h in held[2]], pa.int64())
            docs = pa.StructArray.from_arrays([pa.concat_arrays(held[0]), pa.concat_arrays(held[1]), n], NAMES)
            packed = [pa.array([b], pa.binary()) for b in Chunk.packed(held[2])]
            for x in held:
                x.clear()
            listed = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([listed, *packed], ["docs", *PACKED])

        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                h = token_hashes(text)
                if held[2] and (size + len(h) > CHUNK_TOKENS or len(held[2]) >= CHUNK_DOCS):
                    yield flush()
                    size = 0
                held[0].append(batch.column(0).slice(i, 1))
                held[1].append(batch.column(1).slice(i, 1))
                held[2].append(h)
                size += len(h)
        if held[2]:
            yield flush()

    out = rows.mapInArrow(run, f"docs array<struct<id:{kind},held_out:boolean,n_tokens:bigint>>, one binary, count binary, ranks binary")
    return cut(out.withColumn("chunk", F.monotonically_increasing_id()))


def _sent(chunks: DataFrame, parts: int, unused: int) -> DataFrame:
    """Rows (part, chunk, one, one_count, two, two_count): a chunk's distinct sequences of a part, with their training counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, n, held_out, *packed = (c[i].as_py() for c in batch.columns)
                c = Chunk(*packed, n)
                learn = np.repeat(~np.array(held_out), c.n)
                two, at_two = c.pairs(unused)
                by_part = []
                for h, places, spare in ((c.one, c.at, 0), (two, at_two, unused)):
                    count = np.bincount(places[learn], minlength=len(h))
                    begin = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
                    ranges = [slice(b, e) for b, e in zip(begin, begin[1:], strict=False)]
                    by_part += [[_gaps(h[x], spare) for x in ranges], [_squeezed(count[x]) for x in ranges]]
                arrays = [pa.array(range(parts), pa.int64()), pa.array([chunk] * parts, pa.int64()), *(pa.array(x, pa.binary()) for x in by_part)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "one", "one_count", "two", "two_count"])

    told = chunks.select("chunk", "docs.n_tokens", "docs.held_out", *PACKED)
    return told.mapInArrow(run, "part long, chunk long, one binary, one_count binary, two binary, two_count binary")


def _summed(sent: pa.Table, h: str, c: str, unused: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences, their training counts, where each sent one is among them, and how many each chunk sent."""
    lists = [_hashes(b, unused) for b in sent.column(h).to_pylist()]
    n = np.array([len(x) for x in lists])
    one, at = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.concatenate([_spread(b) for b in sent.column(c).to_pylist()])
    return one, np.bincount(at, counts, len(one)).astype(np.int64), at, n


def _part_filter(one: np.ndarray, c1: np.ndarray, two: np.ndarray, c2: np.ndarray, bits: int) -> LogFrequencyFilter:
    return LogFrequencyFilter.filled(np.concatenate([one[c1 > 0], two[c2 > 0]]), np.concatenate([c1[c1 > 0], c2[c2 > 0]]), bits)


def _answers(sent: DataFrame, bits_per_entry: int, unused: int) -> DataFrame:
    """Rows (chunk, part, kinds, one_count, one_level, two_level) in the order sent; kinds: training tokens, once a part."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        one, c1, at1, n1 = _summed(t, "one", "one_count", 0)
        two, c2, at2, n2 = _summed(t, "two", "two_count", unused)
        lm = _part_filter(one, c1, two, c2, bits_per_entry)
        split = lambda x, n: np.split(x, np.cumsum(n)[:-1])
        kinds = np.zeros(len(t), np.int64)
        kinds[0] = np.count_nonzero(c1)
        columns = [
            t.column("chunk").combine_chunks(), t.column("part").combine_chunks(), pa.array(kinds),
            pa.array([_squeezed(x) for x in split(c1[at1], n1)], pa.binary()),
            *(pa.array([_squeezed(x) for x in split(lm.levels(h)[at], n)], pa.binary()) for h, at, n in ((one, at1, n1), (two, at2, n2))),
        ]
        return pa.Table.from_arrays(columns, ["chunk", "part", "kinds", "one_count", "one_level", "two_level"])

    return sent.groupBy("part").applyInArrow(run, "chunk long, part long, kinds long, one_count binary, one_level binary, two_level binary")


class Model:
    """All parts of a filter and the exact counts of tokens, for a corpus small enough to broadcast."""

    def __init__(self, sent: DataFrame, parts: int, bits_per_entry: int, unused: int):
        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            one, c1, _, _ = _summed(t, "one", "one_count", 0)
            two, c2, _, _ = _summed(t, "two", "two_count", unused)
            bits = _part_filter(one, c1, two, c2, bits_per_entry).bits.tobytes()
            values = [[key[0].as_py()], [bits], [_gaps(one[c1 > 0])], [_squeezed(c1[c1 > 0])]]
            return pa.table(dict(zip(("part", "bits", "one", "count"), values, strict=True)))

        rows = list(sent.groupBy("part").applyInArrow(run, "part long, bits binary, one binary, count binary").toLocalIterator())
        rows = {r["part"]: r for r in rows}
        order = [rows[k] for k in range(parts) if k in rows]
        self.parts = parts
        self.filters = {k: LogFrequencyFilter(np.frombuffer(bytes(r["bits"]), np.uint8)) for k, r in rows.items()}
        self.one = np.concatenate([np.empty(0, np.uint64), *[_hashes(bytes(r["one"])) for r in order]])
        self.count = np.concatenate([np.empty(0, np.uint64), *[_spread(bytes(r["count"])) for r in order]]).astype(np.int64)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted hashes."""
        begin = np.searchsorted(part_of(hashes, self.parts), np.arange(self.parts + 1))
        return np.concatenate([self.filters[k].levels(hashes[begin[k] : begin[k + 1]]) for k in range(self.parts)])

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.one):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.one, hashes), len(self.one) - 1)
        return np.where(self.one[at] == hashes, self.count[at], 0)


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", bits_per_entry: int = BITS_PER_ENTRY
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows where held_out is false, all of them, and scores every row. base_score is the
    add-0.1 unigram log10 probability from exact counts; score interpolates quantised pair and token counts.
    A null or empty text is the end token alone; so is what precedes the first token. Repeated rows count each
    time and score alike. A null id is held out as the column says (null counts as held out). An empty training
    set gives c = N = V = 0; an empty table gives an empty result. More bits_per_entry make fewer false positives. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts, unused = max(1, -(-size // PART_BYTES)), unused_bits(size)
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = _chunks(rows, kind)
    sent = _sent(chunks, parts, unused)
    learnt = F.aggregate(F.filter("docs", lambda d: ~d["held_out"]), F.lit(0).cast("long"), lambda n, d: n + d["n_tokens"])
    total = chunks.agg(F.coalesce(F.sum(learnt), F.lit(0))).first()[0]
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [*NAMES, "n_known", "base_score", "score"]

    if size <= BROADCAST_BYTES:
        told = spark.sparkContext.broadcast(Model(sent, parts, bits_per_entry, unused))

        def run(batches):
            lm = told.value
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = batch.column(0).slice(i, 1).flatten()
                    c = Chunk(*(batch.column(k)[i].as_py() for k in (1, 2, 3)), rows.field("n_tokens").to_pylist())
                    two, at = c.pairs(unused)
                    found = c.scored(total, len(lm.one), lm.exact(c.one), lm.levels(c.one), at, lm.levels(two))
                    yield pa.RecordBatch.from_arrays([*rows.flatten(), *map(pa.array, found)], names)

        scored = chunks.select("docs", *PACKED).mapInArrow(run, schema)
    else:
        answers = cut(_answers(sent, bits_per_entry, unused))
        kinds = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

        def by_chunk(packed: pa.Table, got: pa.Table) -> pa.Table:
            rows = packed.column("docs").combine_chunks().flatten()
            c = Chunk(*(packed.column(k)[0].as_py() for k in PACKED), rows.field("n_tokens").to_pylist())
            order = np.argsort(got.column("part").to_numpy())  # parts are ranges of the sorted hashes
            joined = lambda name: np.concatenate([_spread(b) for b in got.column(name).take(pa.array(order)).to_pylist()]).astype(np.int64)
            found = c.scored(total, kinds, joined("one_count"), joined("one_level"), c.pairs(unused)[1], joined("two_level"))
            return pa.Table.from_arrays([*rows.flatten(), *map(pa.array, found)], names)

        scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(by_chunk, schema)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )
