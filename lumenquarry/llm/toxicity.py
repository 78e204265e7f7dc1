"""Toxicity scores: boosted trees on dense text features with isotonic calibration.

Features are densities of lexicons, second-person words near lexicon words, capitals, punctuation and
obfuscated spellings. Besides a small fixed lexicon there is a learned one: words, and word beginnings (which
catch inflected forms in any language), that labelled training rows show to be commoner in toxic texts. The
model is fitted on a bounded seeded sample of labelled rows in two halves: the features of one half use the
lexicon of the other, and the calibration uses margins of trees grown on the other half, so nothing is judged
on what it was learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.boosting import BoostedTrees, Isotonic
from lumenquarry.llm.common import cut, in_slices, ship_package, text_of

#: Labelled rows that the model is fitted on, at most (about, as a seeded share of all).
SAMPLE_ROWS = 12_000
#: Toxic rows that must hold an entry of the lexicon, and how much commoner it must be there (log of the ratio). The
#: bounded sample bounds the lexicon; no entry that qualifies is left out.
LEXICON_ROWS, LEXICON_ODDS = 3, 1.5
PREFIXES = (4, 5, 6, 8)

# Common insults and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown clowns disgusting "
    "filth filthy vermin pig pigs fool fools jerk creep ugly liar coward imbecile cretin hate kill die shut".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú usted ti tuyo vosotros".split())

_WORDS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_PUNCTUATION = re.compile(r"[^\w\s]+")
_LEET = re.compile(r"[A-Za-z][0-9@$!]+[A-Za-z]|[0-9@$]+[A-Za-z]{2}")
_SPACED = re.compile(r"\b(?:\w[ .*_-]){3,}\w\b")
_MASKED = re.compile(r"\w[*#@$%]{2,}\w?")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñíóú"]
_FOLD = str.maketrans("013457@$!", "oieastasi")
NAMES = (
    "insult_density", "insults", "learned_density", "learned_hits", "learned_sum", "learned_max", "learned_kinds",
    "rare_density", "second_density", "second_near", "capital_rate", "capital_words", "exclamations", "questions",
    "punctuation", "digits", "leet", "spaced", "repeats", "masked", "folded_insults", "log_words", "word_length",
)


def units(word: str) -> list[str]:
    """The word and its beginnings, marked as such."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]


class Lexicon(dict):
    """Word -> the strongest of its units, 0 if none is in the lexicon; looked up once a worker, in a bounded table."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        value = max((self.odds.get(u, 0.0) for u in units(word)), default=0.0)
        if len(self) > 200_000:
            self.clear()
        self[word] = value
        return value

    def __reduce__(self):
        return Lexicon, (self.odds,)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of NAMES."""
    low = text.lower()
    words = _WORDS.findall(low)
    n = len(words) or 1
    chars = len(text) or 1
    values = list(map(lexicon.__getitem__, words))
    hits = [i for i, v in enumerate(values) if v > 0]
    strong = [values[i] for i in hits]
    insult = [i for i, w in enumerate(words) if w in INSULTS]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    marks = {*insult, *hits}
    near = sum(any(j in marks for j in range(i - 4, i + 5)) for i in second) if marks else 0
    odd = [w for w in text.split() if not w.isalpha()]
    leet = [w for w in odd if _LEET.search(w)]
    folded = sum(w in INSULTS or lexicon.odds.get(w, 0.0) > 3 for x in leet for w in _WORDS.findall(x.lower().translate(_FOLD)))
    capitals = _CAPITALS.findall(text)
    masked = len(_MASKED.findall(text)) if any(c in text for c in "*#@$%") else 0
    return [
        len(insult) / n, len(insult), len(strong) / n, len(strong), sum(strong), max(strong, default=0.0),
        len({words[i] for i in hits}), sum(v > 3 for v in strong) / n, len(second) / n, near, sum(map(len, capitals)) / chars,
        sum(len(c) > 2 for c in capitals), text.count("!"), text.count("?"), sum(map(len, _PUNCTUATION.findall(text))) / chars,
        sum(text.count(d) for d in "0123456789") / chars, len(leet) / n, len(_SPACED.findall(text)),
        sum(low.count(t) for t in _TRIPLES) / n, masked / n, folded, np.log1p(len(words)), chars / n,
    ]


class Model:
    """A fitted scorer; small, so it is broadcast."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibrate: Isotonic):
        self.lexicon, self.trees, self.calibrate = Lexicon(lexicon), trees, calibrate

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return self.calibrate(self.trees.margin(x))


def _lexicon(counted: DataFrame, toxic: Column, rows: Column, n_toxic: int, n_clean: int) -> dict[str, float]:
    odds = F.log((toxic + 0.3) / (n_toxic + 1)) - F.log((rows - toxic + 0.3) / (n_clean + 1))
    kept = counted.where(toxic >= LEXICON_ROWS).withColumn("odds", odds).where(F.col("odds") >= LEXICON_ODDS)
    return {r["u"]: r["odds"] for r in kept.select("u", "odds").collect()}


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows where held_out is false: a seeded sample of about SAMPLE_ROWS at most.

    Of docs only the id and the text are read, of labels the id and toxic, whatever other columns are called. A
    document that is there twice counts twice; a label that is there twice is toxic if one says so. The driver gets lexicons and the features of the sample, no texts; words are counted where they are. Rows
    with a null id or label are left out. Without labelled rows of both kinds the score is a constant.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.where(~held_out).select(id_col, "toxic").where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 1.0
    draw = lambda seed, c: F.crc32(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary")) / float(2**32)
    sample = known.where(draw("sample", id_col) < share).select(F.col(id_col).alias("id"), "label")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "id").select(F.col("id").cast("string").alias("id"), "label", "text")  # at most about SAMPLE_ROWS labels
    rows = cut(rows.withColumn("half", (draw("half", "id") < 0.5).cast("int")))

    def split(batches):
        for batch in in_slices(batches):
            held = [sorted({u for w in set(_WORDS.findall(t.lower())) for u in units(w)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.string()))], ["label", "half", "units"])

    found = rows.select("label", "half", "text").mapInArrow(split, "label int, half int, units array<string>")
    in_half = lambda c, k: F.sum(F.when(F.col("half") == k, c).otherwise(0))
    counted = found.select("label", "half", F.explode("units").alias("u")).groupBy("u").agg(
        *[in_half(F.col("label"), k).alias(f"t{k}") for k in (0, 1)], *[in_half(F.lit(1), k).alias(f"n{k}") for k in (0, 1)]
    )
    counted = cut(counted.where("t0 + t1 > 1"))
    sizes = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    size = lambda label, *halves: sum(sizes.get((h, label), 0) for h in halves)
    # a row's features use the lexicon of the half that it isn't in
    apart = [_lexicon(counted, F.col(f"t{k}"), F.col(f"n{k}"), size(1, k), size(0, k)) for k in (1, 0)]
    whole = _lexicon(counted, F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1"), size(1, 0, 1), size(0, 0, 1))
    told = spark.sparkContext.broadcast([Lexicon(x) for x in apart])

    def measure(batches):
        for batch in in_slices(batches):
            x = [features(t, told.value[h]) for t, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "half", "x"])

    table = rows.select("id", "label", "text", "half").mapInArrow(measure, "id string, label int, half int, x array<double>").toArrow().sort_by("id")
    y, half = (table.column(c).to_numpy().astype(np.float64) for c in ("label", "half"))
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    # calibration: margins of each half from trees grown on the other
    margins = np.zeros(len(y))
    for k in (0, 1):
        margins[half == k] = BoostedTrees().fit(x[half != k], y[half != k]).margin(x[half == k])
    return Model(whole, BoostedTrees().fit(x, y), Isotonic(margins, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1). A null text scores as an empty one; repeated rows score alike."""
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told.value.scores(batch.column(1).to_pylist()))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below the threshold. A null text is judged as an empty one; repeated
    rows all stay or all go; an empty table stays empty."""
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.empty(0), *[told.value.scores(texts[at : at + 512].tolist()) for at in range(0, len(texts), 512)]]))

    return docs.where(scored(text_of(text_col)) < threshold)
