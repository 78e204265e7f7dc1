"""Scores and joins of the legal layer: entity linking, applicable rules, precedents, verdict chains, query rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.functions.text import jaccard, tokens
from lumenquarry.operators.graph import cut

# Weights of a link candidate's parts.
LINK_WEIGHTS = {"name": 0.45, "type": 0.20, "identity": 0.20, "context": 0.10, "anchor": 0.05}


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, 0.85 where one holds the other, else 0.7 times one minus the normalised edit distance."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.85).otherwise(0.7 * (1 - F.levenshtein(a, b) / longest))


def context_score(a: Column, b: Column) -> Column:
    """0.5 and 0.1 for each shared token, at most 1."""
    return F.least(F.lit(1.0), 0.5 + 0.1 * F.size(F.array_intersect(a, b)))


def link(mentions: DataFrame, candidates: DataFrame, block: str, among: Column | None = None, least: float = 0.5) -> DataFrame:
    """Best candidate of each mention: (m_id, c_id, score), within a blocking key so that no pair outside it is scored.

    mentions (m_id, block, name, type, tokens), candidates (c_id, block, name, type, tokens); `among` may restrict the
    pairs. Ties: the smaller id.
    """
    m = mentions.select("m_id", block, F.lower("name").alias("m_name"), F.col("type").alias("m_type"), F.col("tokens").alias("m_tokens"))
    c = candidates.select("c_id", block, F.lower("name").alias("c_name"), F.col("type").alias("c_type"), F.col("tokens").alias("c_tokens"))
    w = LINK_WEIGHTS
    score = (
        w["name"] * name_score(F.col("m_name"), F.col("c_name")) + w["type"] * (F.col("m_type") == F.col("c_type")).cast("double")
        + w["identity"] * (F.col("m_name") == F.col("c_name")).cast("double") + w["context"] * context_score(F.col("m_tokens"), F.col("c_tokens"))
        + w["anchor"] * F.startswith("c_name", F.substring("m_name", 1, 3)).cast("double")
    )
    pairs = m.join(c, block) if among is None else m.join(c, block).where(among)
    scored = pairs.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return scored.groupBy("m_id").agg(F.max(F.struct("score", -F.col("c_id"))).alias("best")).select("m_id", (-F.col("best.col2")).alias("c_id"), "best.score")


def canonical_id(kind: Column, number: Column, year: Column) -> Column:
    """Typed id from its parts; null where a needed part is missing."""
    return F.when(kind == "law", F.concat(F.lit("law:"), number)).when(kind == "case", F.concat(F.lit("case:"), year, F.lit("/"), number)).otherwise(F.concat(F.lit("entity:"), number))


def applicable_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of a rule's condition keywords that occur in a case's facts as substrings: (case_id, rule_id, score > 0).

    rules (rule_id, condition), facts (case_id, text). A keyword has no white space, so it lies inside a token: the
    substrings of the distinct tokens meet the keywords by an equality join, and nothing is compared pair by pair.
    """
    k = rules.select("rule_id", F.explode(F.array_distinct(tokens(F.col("condition")))).alias("k"))
    total = k.groupBy("rule_id").agg(F.count("*").alias("n"))
    held = facts.select("case_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    words = k.groupBy("k").agg(F.length("k").alias("n"))
    sizes = words.agg(F.collect_set("n").alias("sizes"))  # the lengths of keywords: one row
    inside = held.select("w").distinct().join(F.broadcast(sizes)).where(F.col("sizes").isNotNull())
    inside = inside.select("w", F.explode(F.filter("sizes", lambda n: n <= F.length("w"))).alias("n"))
    starts = F.sequence(F.lit(1), F.length("w") - F.col("n") + 1)
    inside = inside.select("w", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("w"), i, F.col("n"))))).alias("k"))
    inside = cut(inside.join(words.select("k"), "k"))
    found = held.join(inside, "w").select("case_id", "k").distinct()
    hits = found.join(k, "k").groupBy("case_id", "rule_id").agg(F.count("*").alias("h"))
    return hits.join(total, "rule_id").select("case_id", "rule_id", F.round(F.col("h") / F.col("n"), 6).alias("score"))


def similar_precedents(cases: DataFrame, asked: DataFrame, least: float = 0.1, top: int = 5) -> DataFrame:
    """Top precedents by token Jaccard: a shared-token join gives the intersections, sizes the rest."""
    c = cases.select("case_id", F.array_distinct(tokens(F.col("text"))).alias("t")).withColumn("n", F.size("t"))
    q = asked.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("t")).withColumn("m", F.size("t"))
    both = c.select("case_id", "n", F.explode("t").alias("w")).join(q.select("query_id", "m", F.explode("t").alias("w")), "w")
    s = both.groupBy("query_id", "case_id", "n", "m").agg(F.count("*").alias("i"))
    s = s.select("query_id", "case_id", F.round(F.col("i") / (F.col("n") + F.col("m") - F.col("i")), 6).alias("score")).where(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id"))
    return s.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def node_score(confidence: Column, match: Column, similarity: Column, usage: Column) -> Column:
    """0.4 confidence + 0.3 the first of match and similarity that isn't 0 + 0.3 usage / 100."""
    return 0.4 * confidence + 0.3 * F.coalesce(F.nullif(match, F.lit(0.0)), similarity) + 0.3 * usage / 100


def severity(text: Column, critical: list[str], high: list[str], low: list[str]) -> Column:
    """0.5, plus 0.3 / 0.2 / minus 0.2 for keywords of a band, within 0 and 1."""
    has = lambda words: text.rlike("|".join(words))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.when(has(critical), 0.3).when(has(high), 0.2).when(has(low), -0.2).otherwise(0.0)))


def rewrites(queries: DataFrame, corrections: list[tuple[str, str]], synonyms: dict[str, list[str]], top: int = 5) -> DataFrame:
    """Variants of each query: (query_id, variant, kind, confidence, rank); corrections, then synonyms (.8), then a template (.7)."""
    fixed = F.col("text")
    for wrong, right in corrections:
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    variants = [F.struct(fixed.alias("variant"), F.lit("correction").alias("kind"), F.lit(1.0).alias("confidence"))]
    for word, others in synonyms.items():
        for other in others[:3]:
            v = F.regexp_replace(fixed, rf"\b{word}\b", other)
            variants.append(F.struct(v.alias("variant"), F.lit("synonym").alias("kind"), F.lit(0.8).alias("confidence")))
    variants.append(F.struct(F.concat(F.lit("what is "), fixed).alias("variant"), F.lit("template").alias("kind"), F.lit(0.7).alias("confidence")))
    rows = queries.select("query_id", F.explode(F.array(*variants)).alias("v")).select("query_id", "v.*")
    best = rows.groupBy("query_id", "variant").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("query_id", "variant", "b.confidence", "b.kind")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "variant"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def text_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))
