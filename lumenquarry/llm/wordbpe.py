"""Token ids of whole texts with a word-level BPE file, several times faster than encoding each text.

The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its
white-space pieces in turn. Pieces repeat: Arrow makes those of many texts distinct, each worker keeps the ids of
pieces it has met in a bounded table, and the words it hasn't met go through the BPE model together.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the table of a worker, and at most a block's more; it starts anew when full.
TABLE_SIZE = 300_000
#: Bytes of text whose pieces are made distinct at once; a longer text is on its own.
TEXT_BYTES = 4 << 20
#: Bytes of the longest word or piece that the table keeps.
LONGEST = 40
_LETTERS = bytes([*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
_MARKS = string.punctuation.encode()


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: visible Latin-1 as itself, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


class WordTable:
    """Piece (bytes, ASCII lower case) -> its ids as packed little-endian unsigned 32-bit numbers.

    Two generations of at most TABLE_SIZE entries: when the young one is full it becomes the old one, and
    pieces met again move over, so common ones never leave. It is looked at once a block of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer.normalize_str
        self.words = Tokenizer(self.tokenizer.model)  # of words in stand-ins, a space between them
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.chars = _byte_chars()
        self.chars[ord(" ")] = " "
        vocab, end = self.words.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        self.letters: dict[str, bool] = {}
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _is_letter(self, char: str) -> bool:
        """As the tokenizer's own pattern has it: two letters are one piece and a full stop after them another."""
        known = self.letters.get(char)
        if known is None:
            known = self.letters[char] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(char * 2 + ".")) == 2
        return known

    def _ends_in_letter(self, word: bytes) -> bool:
        return self._is_letter(self.normal(word.decode("utf-8", "replace"))[-1:])

    def _any(self, piece: bytes) -> bytes:
        ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Those that are letters only and that the normaliser leaves as they are, so the BPE model can have them."""
        out = [w for w in words if w.isascii()]
        if len(out) == len(words):
            return out
        others = [w for w in words if not w.isascii()]
        texts = b" ".join(others).decode("utf-8", "replace")
        letters = {c for c in set(texts) if self._is_letter(c)}
        pairs = [(w, t) for w, t in zip(others, texts.split(" "), strict=True) if letters.issuperset(t)]
        if pairs:  # a space joins with no letter
            after = self.normal(" ".join([t for _, t in pairs])).split(" ")
            out += [w for (w, t), x in zip(pairs, after, strict=True) if t == x]
        return out

    def _bpe(self, words: list[bytes]) -> list[bytes]:
        """Of plain words, straight from the BPE model."""
        text = b" ".join(words).decode("latin-1").translate(self.chars)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a model that doesn't mark the ends of words
            return list(map(self._any, words))
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _tail(self, marks: bytes) -> bytes:
        ids = self.young.get(marks)
        if ids is None:
            ids = self._any(marks)
            if len(marks) <= LONGEST:
                self.young[marks] = ids
        return ids

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces that the young generation lacks."""
        out = list(map(self.old.get, pieces))
        kept = {p: ids for p, ids in zip(pieces, out, strict=True) if ids is not None}
        words, marked, others = [], [], []
        for k, piece in enumerate(pieces):
            if out[k] is None:
                head = piece.rstrip(_MARKS)
                if not head or len(head) > LONGEST or head.translate(None, _LETTERS):
                    others.append(k)
                elif len(head) == len(piece):
                    words.append(piece)
                else:
                    marked.append((k, head, piece[len(head) :]))
        heads = {head for _, head, _ in marked}
        ids = {}
        for table in (self.young, self.old):
            ids.update((w, x) for w in heads if (x := table.get(w)) is not None)
        plain = self._plain([*words, *heads.difference(words)])
        new = [w for w in plain if w not in ids] if ids else plain
        made = dict(zip(new, self._bpe(new), strict=True)) if new else {}
        made.update((w, self._any(w)) for w in heads.union(words) - made.keys() - ids.keys())
        kept.update(made)
        ids.update(made)
        tails, plain = {marks: self._tail(marks) for marks in {marks for _, _, marks in marked}}, set(plain)
        for k, head, marks in marked:
            if head in plain or self._ends_in_letter(head):  # one entry for a word, whatever follows it
                out[k] = ids[head] + tails[marks]
            else:  # marks after a character that is no letter are one run with it
                others.append(k)
        for k in others:
            out[k] = self._any(pieces[k])
            if len(pieces[k]) <= LONGEST:
                kept[pieces[k]] = out[k]
        out = [made[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
        if len(self.young) >= TABLE_SIZE:
            self.old, self.young = self.young, {b"": b""}
        self.young.update(kept)
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Of different pieces."""
        out = list(map(self.young.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            for k, ids in zip(missing, self._learn([pieces[k] for k in missing]), strict=True):
                out[k] = ids
        return out

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        large = pa.types.is_large_binary(texts.type)
        texts = texts.view(pa.large_string() if large else pa.string())
        pool = pa.system_memory_pool()  # its blocks are used again, with fewer page faults than Arrow's own
        # special tokens are found before letters are lower-cased
        special = pc.match_substring(texts, "<|", memory_pool=pool)
        texts = pc.if_else(special, texts, pc.ascii_lower(texts, memory_pool=pool), memory_pool=pool)
        split = pc.ascii_split_whitespace(texts, memory_pool=pool)
        coded = pc.dictionary_encode(split.flatten(), memory_pool=pool)
        pieces = coded.dictionary.view(pa.large_binary() if large else pa.binary())
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(len(split), np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        ids = self._ids(pc.binary_join(one, pa.scalar(b" ", pieces.type), memory_pool=pool)[0].as_py().split(b" "))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of = coded.indices.to_numpy()
        sizes, first = sizes[of], (np.cumsum(sizes) - sizes)[of]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), "<u4")[at], ends[split.offsets.to_numpy()[1:]]

    def encode_all(self, texts: pa.Array) -> Iterator[memoryview]:
        """Packed ids of each of the whole UTF-8 texts (binary, no nulls) in turn."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            ids, stops = self._block(texts.slice(at, to - at))
            packed, start = memoryview(ids.tobytes()), 0
            for stop in (4 * stops).tolist():
                yield packed[start:stop]
                start = stop
            at = to

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a whole UTF-8 text."""
        return bytes(next(self.encode_all(pa.array([text], pa.binary()))))


@lru_cache(maxsize=1)
def _table(path: str, changed: int, size: int) -> WordTable:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # idle threads would spin beside the one text of a call
    return WordTable(path)


def table_of(path: str) -> WordTable:
    """The table of this process, which the tasks that a worker runs in turn share; anew for another or a changed file."""
    at = os.stat(path)
    return _table(path, at.st_mtime_ns, at.st_size)
