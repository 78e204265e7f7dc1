"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Only lengths matter to a packing, and they are at most the capacity. So the driver packs the histogram of
lengths - at most `capacity` numbers however many documents there are - and works on groups of equal bins:
best-fit decreasing opens few groups (each length splits at most one group), then the local search exchanges
one for one, two for one, or moves documents between underfull bins of two groups, for as many bins of both as
there are, whenever the sum of squared fills grows. Documents then take the places of their length in an
arbitrary fixed order: they are ranked inside hash blocks, and the plan (bounded by the capacity, not by the
data) tells sequence and offset for a rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.llm.common import blocks_for, cut, in_slices, ship_package, text_of, with_offsets

CAPACITY = 2048
#: Pairs of groups that the local search remembers as settled (about 100 bytes each); it forgets them beyond that.
TRIED = 4_000_000

Bin = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _with(bin_: Bin, change: dict[int, int]) -> Bin:
    counts = dict(bin_)
    for length, n in change.items():
        counts[length] = counts.get(length, 0) + n
    return tuple(sorted(((x, n) for x, n in counts.items() if n), reverse=True))


def _fill(bin_: Bin) -> int:
    return sum(length * n for length, n in bin_)


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Bin, int]:
    """Best-fit decreasing on a histogram: groups of equal bins and their sizes."""
    by_room: dict[int, dict[Bin, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(bin_: Bin, n: int) -> None:
        room = capacity - _fill(bin_)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room][bin_] = by_room[room].get(bin_, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                bin_, have, room = (), left, capacity
            else:
                room = rooms[at]
                bin_, have = by_room[room].popitem()
                if not by_room[room]:
                    rooms.pop(at)
            each = min(room // length, left)
            n = min(have, left // each)
            put(_with(bin_, {length: each}), n)
            if bin_ and have > n:
                put(bin_, have - n)
            left -= n * each
    out: dict[Bin, int] = {}
    for group in by_room.values():
        out.update(group)
    return out


def _better(a: Bin, b: Bin, room: int) -> tuple[dict[int, int], dict[int, int]] | None:
    """The change of bins a (fuller) and b that fills a most: a move, a swap, or a two-for-one exchange."""
    most, found = 0, None
    mine, theirs = [x for x, _ in a], [x for x, _ in b]
    own = dict(b)
    for y in theirs:
        if most < y <= room:
            most, found = y, ({y: 1}, {y: -1})
        for x in mine:
            if most < y - x <= room:
                most, found = y - x, ({y: 1, x: -1}, {y: -1, x: 1})
    if most == room:
        return found
    held = dict(a)
    for x in mine:
        for i, y in enumerate(theirs):
            for z in theirs[i:]:
                if most < y + z - x <= room and (y != z or own[y] > 1):
                    gain = defaultdict(int, {x: -1})
                    loss = defaultdict(int, {x: 1})
                    for w in (y, z):
                        gain[w] += 1
                        loss[w] -= 1
                    most, found = y + z - x, (dict(gain), dict(loss))
    for y in theirs:
        for i, x in enumerate(mine):
            for z in mine[i:]:
                if most < y - x - z <= room and (x != z or held[x] > 1):
                    gain = defaultdict(int, {y: 1})
                    loss = defaultdict(int, {y: -1})
                    for w in (x, z):
                        gain[w] -= 1
                        loss[w] += 1
                    most, found = y - x - z, (dict(gain), dict(loss))
    return found


def local_search(bins: dict[Bin, int], capacity: int) -> dict[Bin, int]:
    """Raise the sum of squared fills by exchanges between underfull bins until as many are empty as can be or none helps.

    Every change raises that sum, so the search ends; a pair of groups that no exchange helps is not tried again.
    """
    bins = dict(bins)
    least = -(-sum(_fill(b) * n for b, n in bins.items()) // capacity)
    tried: set[tuple[Bin, Bin]] = set()
    changed = True
    while changed and sum(bins.values()) > least:
        under = sorted((b for b in bins if _fill(b) < capacity), key=lambda b: (_fill(b), b))
        fills = {b: _fill(b) for b in under}
        changed = False
        if len(tried) > TRIED:
            tried.clear()
        for giver in under:
            for taker in reversed(under):
                if giver not in bins or fills[taker] < fills[giver]:
                    break
                if taker not in bins or (taker, giver) in tried or (taker == giver and bins[giver] < 2):
                    continue
                if not (change := _better(taker, giver, capacity - fills[taker])):
                    tried.add((taker, giver))
                    continue
                n = min(bins[taker], bins[giver]) if taker != giver else bins[giver] // 2
                for old, diff in ((taker, change[0]), (giver, change[1])):
                    bins[old] -= n
                    if new := _with(old, diff):
                        bins[new] = bins.get(new, 0) + n
                for old in {taker, giver}:
                    if not bins[old]:
                        del bins[old]
                changed = True
    return bins


class Plan:
    """Where the r-th piece of each length goes; its size is bounded by the capacity."""

    def __init__(self, bins: dict[Bin, int], capacity: int):
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for bin_, n in sorted(bins.items(), reverse=True):
            offset = 0
            for length, each in bin_:
                for _ in range(each):
                    runs[length].append((n, first, offset))
                    offset += length
            first += n
        self.sequences = first
        self.start = np.zeros(capacity + 2, np.int64)
        flat = []
        for length in range(capacity + 1):
            self.start[length] = len(flat)
            rank = 0
            for n, seq, offset in runs.get(length, ()):
                flat.append((rank, seq, offset))
                rank += n
        self.start[capacity + 1] = len(flat)
        self.runs = np.array(flat, np.int64).reshape(-1, 3)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # runs are in order of (length, first rank): one search over a joint key
        width = int(max(ranks.max(initial=0), self.runs[:, 0].max(initial=0))) + 1
        of = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        at = np.searchsorted(of * width + self.runs[:, 0], lengths * width + ranks, "right") - 1
        return self.runs[at, 1] + ranks - self.runs[at, 0], self.runs[at, 2]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32); tokens stay in the worker."""
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from lumenquarry.llm.wordbpe import table_of

        table, end = table_of(tokenizer), np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        for batch in in_slices(batches, 4096):
            ids, out = batch.column(0), ([], [], [], [], [])
            for row, text_ids in enumerate(table.encode_all(batch.column(1))):
                packed = bytes(text_ids) + end
                for k, at in enumerate(range(0, len(packed), size)):
                    part = packed[at : at + size]
                    for to, v in zip(out, (row, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(v)
            columns = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and end_id make it; only documents over the capacity are cut. A null or empty text is the
    end id alone. Rows that repeat an id are packed each for itself. An empty table gives an empty result.
    tokenizer: the path of a tokenizers file that every worker can open.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(local_search(best_fit(histogram, capacity), capacity), capacity)
    blocks = blocks_for(sum(histogram.values()), 4)
    key = F.xxhash64("id", "piece", "ids_crc32")
    rows = pieces.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int"))
    rows = with_offsets(rows, ["length"], "block", F.lit(1), "before")
    inside = Window.partitionBy("length", "block", "before").orderBy(F.col("id").asc_nulls_first(), "piece", "ids_crc32")
    rows = rows.withColumn("rank", (F.col("before") + F.row_number().over(inside) - 1).cast("long")).drop("block", "before")
    told = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = told.value.place(lengths, ranks)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(seq), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
