"""Personal data: base patterns, and terms that the corpus shows to reveal a protected entity.

Base kinds (email, ip, card, phone) are patterns with their checks. Their values are the protected entities.
For every entity and every word of the texts that mention it, however far away, the corpus gives the number of
texts that hold both and the number that hold the word. Their ratio is the posterior: how surely someone who reads the word knows the
entity; its logarithm against the entity's own share is the information disclosed, in bits. Words that exceed
both thresholds with enough support are terms: their occurrences are marked in every text, generalised where
the posterior is moderate and removed where it is high. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import cut, text_of

# Patterns of the base kinds, in order. Possessive where that changes no match, so that no text is
# searched twice; an address starts where a run of its characters starts or the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")

#: The least letters of a word that is a candidate.
LETTERS = 4
#: A term's least posterior, least bits, least number of different texts with the entity.
POSTERIOR, BITS, SUPPORT = 0.5, 4.0, 2
#: Posterior from which a term is removed and not generalised.
REMOVE = 0.9
#: Terms that are broadcast to find them in texts (8 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def lowered(text: Column) -> Column:
    """ASCII letters in lower case; every position stays."""
    return F.translate(text, _UPPER, _LOWER)


def matches(text: Column, pattern: Column, kind: int, possible: Column) -> Column:
    """Array of SPAN: leftmost non-overlapping matches with positions in code points, where `possible` holds.

    The text is parted at the matches; the lengths of parts and matches add up to the positions.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.call_function("split", text, pattern, F.lit(-1))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    none = F.array().cast(f"array<{SPAN}>")
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (start(acc, x) + F.length(x["value"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                F.lit(kind).alias("kind"), start(acc, x).alias("start"),
                (start(acc, x) + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            ))).alias("spans"),
        ),
    )["spans"]
    return F.when(possible & (F.size(found) > 0), walked).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    def weighted(i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(places, weighted), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Array of SPAN: the base kinds in a text, by kind, then start. A match that fails its check is dropped."""
    n = lambda s: F.length(_digits(s["value"]))
    email = matches(text, F.lit(EMAIL), 0, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, F.lit(IP), 1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda s: _small_parts(s["value"]))
    card = F.filter(
        matches(text, F.lit(CARD), 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        lambda s: n(s).between(13, 19) & F.when(n(s).between(13, 19), _luhn(_digits(s["value"]))).otherwise(False),
    )
    phone = F.filter(matches(text, F.lit(PHONE), 3, F.contains(text, F.lit("+"))), lambda s: n(s).between(9, 15))
    return F.concat(email, ip, card, phone)


def _words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), r"\P{L}+", -1), lambda w: F.length(w) >= LETTERS)


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """Rows (term, posterior) from rows (text, spans): words that disclose an entity beyond the thresholds.

    Texts that hold an entity or a word count once each, however often it is in them; copies of a text count
    as one for the support. The counts are taken over every row.
    """
    total = rows.count()
    held = rows.select(F.explode(F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))).alias("h"))
    df = held.groupBy("h").agg(F.count("*").alias("n_term"))
    # rows of one text: a digest counts as often as the text is there
    with_entity = rows.where(F.size("spans") > 0).select(F.xxhash64("text").alias("digest"), "text", "spans")
    times = with_entity.groupBy("digest").agg(F.count("*").alias("times"), F.first("spans").alias("spans"))
    mentions = times.select("digest", "times", F.explode("spans").alias("s"))
    entity = F.xxhash64("s.kind", "s.value").alias("entity")
    mentions = mentions.select("digest", "times", entity, _words(F.col("s.value")).alias("own"))
    mentions = cut(mentions.dropDuplicates(["digest", "entity"]))
    entities = mentions.groupBy("entity").agg(F.sum("times").alias("n_entity"), F.count("*").alias("n_texts"))
    # no pair that passes is lost: n_both is at most n_entity, so these bounds follow from the thresholds
    entities = entities.where((F.col("n_texts") >= SUPPORT) & (F.log2(F.col("n_entity") / F.lit(float(total))) <= -BITS)).drop("n_texts")
    mentions = cut(mentions.join(entities, "entity"))
    most = mentions.groupBy("digest").agg(F.max("n_entity").alias("most"))
    terms = with_entity.select("digest", "text").join(most, "digest")
    terms = terms.select("digest", "most", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    terms = terms.withColumn("h", F.xxhash64("term")).join(df.where(F.col("n_term") >= SUPPORT), "h")
    terms = terms.where(F.col("n_term") * POSTERIOR <= F.col("most")).select("digest", "term", "n_term").dropDuplicates(["digest", "term"])
    both = terms.join(mentions, "digest").where((F.col("n_term") * POSTERIOR <= F.col("n_entity")) & ~F.array_contains("own", F.col("term")))
    both = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("times").alias("n_both"), F.count("*").alias("n_texts"))
    both = both.where(F.col("n_texts") >= SUPPORT)
    posterior = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    bits = F.log2(posterior) - F.log2(F.col("n_entity") / F.lit(float(total)))
    found = both.where((posterior >= POSTERIOR) & (bits >= BITS))
    return found.groupBy("term").agg(F.max(posterior).alias("posterior"))


def _checked_broadcast(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text, spans (array of SPAN by kind, then start; base kinds and terms), removed.

    A null text is empty and has no span. removed lists the terms of the text that are taken out whole. A term
    that overlaps a base span isn't marked again. Rows that repeat a text or an id get the same spans. Empty
    table: empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    terms = cut(disclosing_terms(rows))
    lookup = terms.select(F.xxhash64("term").alias("h"), "term", (F.col("posterior") >= REMOVE).alias("remove"))
    key = F.xxhash64("id", "text").alias("key")
    held = rows.select(key, F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).select("key", "w", F.xxhash64("w").alias("h"))
    held = held.join(_checked_broadcast(lookup), "h").where("w = term")
    held = held.groupBy("key").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.sort_array(F.collect_set(F.when(F.col("remove"), F.col("term")))).alias("removed")
    )
    rows = rows.withColumn("key", key).join(held, "key", "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.concat_ws("|", "terms"), F.lit(r")(?!\p{L})"))
    marked = F.when(
        F.col("terms").isNotNull(), matches(lowered(F.col("text")), F.coalesce(pattern, F.lit("$^")), 4, F.lit(True))
    ).otherwise(F.array().cast(f"array<{SPAN}>"))
    clear = F.filter(marked, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return rows.select(
        F.col("id").alias(id_col), "text", F.concat("spans", clear).alias("spans"),
        F.coalesce("removed", F.array().cast("array<string>")).alias("removed"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def sanitised(text: Column, spans: Column, removed: Column) -> Column:
    """The text with base spans as [KIND], removed terms gone and other terms as [TERM]; overlaps: the first span."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    def step(acc, s):
        label = F.when((s["kind"] == 4) & F.array_contains(removed, s["value"]), F.lit("")).otherwise(F.get(names, s["kind"]))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, label).alias("out"))).otherwise(acc)
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
