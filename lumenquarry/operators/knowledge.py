"""Entities, edges and text scores of the knowledge layer, mostly Column expressions; loops are over bounded depth."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.functions.text import jaccard, tokens
from lumenquarry.operators.graph import bfs, cut

# Words that negate a statement.
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "keine", "ne", "pas")


def valid_entities(entities: DataFrame, least: float, labels: list[str], text: str = "text", label: str = "label", score: str = "score") -> DataFrame:
    """Entities with a text of two characters or more, an allowed label and a score of at least `least`."""
    return entities.where((F.length(F.trim(text)) >= 2) & F.col(label).isin(*labels) & (F.col(score) >= least))


def entity_statistics(entities: DataFrame, label: str = "label", source: str = "source", score: str = "score") -> DataFrame:
    """Rows (kind, key, n, mean_score): all entities, each label, each source; one aggregate with grouping sets."""
    e = entities.select(F.col(label).alias("l"), F.col(source).alias("s"), F.col(score).alias("x"))
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key")) for k, v in (("total", F.lit("all")), ("label", F.col("l")), ("source", F.col("s")))])
    rows = e.select(F.explode(keys).alias("k"), "x").select("k.*", "x")
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_score"))


def reference_edges(docs: DataFrame, lists: dict[str, Column], id_col: str) -> DataFrame:
    """Edges (src, dst, kind) from arrays of referenced ids, once each, to ids that exist; none to itself."""
    def named(kind: str, ids: Column) -> Column:
        return F.transform(F.coalesce(ids, F.slice(ids, 1, 0), F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("dst")))

    refs = F.concat(*[named(k, c) for k, c in lists.items()])
    rows = docs.select(F.col(id_col).alias("src"), F.explode(refs).alias("r")).select("src", "r.dst", "r.kind").where("src <> dst").distinct()
    return rows.join(docs.select(F.col(id_col).alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


def entity_edges(entities: DataFrame, near: int, relations: list[tuple[str, str]], doc: str = "doc", at: str = "at", label: str = "label", id_col: str = "id") -> DataFrame:
    """Edges (src, dst, kind) between entities of one document, i before j: within `near` characters, or of one label,
    or of labels that a relation (from, to) names; a relation gives the direction. One edge for a pair and kind.
    """
    a, b = (entities.select(doc, F.col(at).alias(f"at_{k}"), F.col(label).alias(f"l_{k}"), F.col(id_col).alias(k)) for k in "ab")
    p = a.join(b, doc).where((F.col("at_a") < F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("a") < F.col("b"))))
    none = F.lit(None).cast("struct<src:bigint,dst:bigint,kind:string>")
    edge = lambda s, d, k: F.struct(F.col(s).cast("long").alias("src"), F.col(d).cast("long").alias("dst"), F.lit(k).alias("kind"))
    one = lambda x, y: reduce(Column.__or__, [(F.col(x) == f) & (F.col(y) == t) for f, t in relations], F.lit(False))
    kinds = F.array(
        F.when(F.col("at_b") - F.col("at_a") < near, edge("a", "b", "near")).otherwise(none),
        F.when(F.col("l_a") == F.col("l_b"), edge("a", "b", "same_label")).otherwise(none),
        F.when(one("l_a", "l_b"), edge("a", "b", "relation")).when(one("l_b", "l_a"), edge("b", "a", "relation")).otherwise(none),
    )
    return p.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("e")).select("e.*").distinct()


def linked_case(cases: DataFrame, case: str, links: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, type) of cases with their persons, courts and so on.

    links: node type -> column. Ids are generated from type and name, so equal ones are one node.
    """
    gen = lambda kind, name: F.substring(F.md5(F.concat_ws(":", F.lit(kind), name.cast("string"))), 1, 16)
    parts = F.array(*[F.struct(F.lit(k).alias("type"), F.col(c).cast("string").alias("name"), gen(k, F.col(c)).alias("id")) for k, c in links.items()])
    rows = cases.select(gen("case", F.col(case)).alias("case_id"), F.col(case).cast("string").alias("case_name"), F.explode(parts).alias("p")).where("p.name is not null")
    nodes = rows.select(F.col("case_id").alias("id"), F.lit("case").alias("type"), F.col("case_name").alias("name")).unionByName(rows.select("p.id", "p.type", "p.name"))
    edges = rows.select(F.col("case_id").alias("src"), F.col("p.id").alias("dst"), F.concat(F.lit("has_"), "p.type").alias("type"))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def edge_quality(confidence: Column, has_evidence: Column) -> Column:
    """0.5 + 0.3 confidence + 0.2 where there is evidence, at most 1."""
    return F.least(F.lit(1.0), 0.5 + 0.3 * confidence + F.when(has_evidence, 0.2).otherwise(0.0))


def band(p: Column, level: float) -> tuple[Column, Column]:
    """p less and plus half of what the level leaves, within 0 and 1; not a statistical interval."""
    half = (1 - level) / 2
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def usage_score(base: Column, usage: Column, success: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """base * (1 + usage) * success, kept between low and high."""
    return F.least(F.lit(high), F.greatest(F.lit(low), base * (1 + usage) * success))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of gone (id) and without edges at them, where `ends` says which ends share their ids."""
    g = gone.select("id").distinct()
    for end in ends:
        edges = edges.join(g.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(g, "id", "left_anti"), edges


def distance_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, hops: int = 3) -> DataFrame:
    """The fallback of personalised rank: damping * damping ** distance of nodes within some hops of the seeds."""
    return bfs(edges, seeds, hops).select("id", (damping * F.pow(F.lit(damping), F.col("distance"))).alias("rank"))


def severity_of_contradiction(confidence_a: Column, confidence_b: Column) -> Column:
    """The mean confidence times one minus the difference."""
    return (confidence_a + confidence_b) / 2 * (1 - F.abs(confidence_a - confidence_b))


def negates(words: Column) -> Column:
    """True where an array of words holds a negation."""
    return F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS)))


def contradictory(a: Column, b: Column, least: float = 0.5) -> Column:
    """Texts with a token Jaccard above `least` of which exactly one negates."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return (jaccard(x, y) > least) & (negates(x) != negates(y))


def canonical(text: Column, synonyms: dict[str, str]) -> Column:
    """The tokens of a text, each in its canonical form."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.transform(tokens(text), lambda w: F.coalesce(F.try_element_at(table, w), w))


def semantic_similarity(a: Column, b: Column, synonyms: dict[str, str]) -> Column:
    """Jaccard of canonical tokens; 1 where both texts are empty."""
    x, y = F.array_distinct(canonical(a, synonyms)), F.array_distinct(canonical(b, synonyms))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(jaccard(x, y))


def opposed(a: Column, b: Column, antonyms: list[tuple[str, str]], synonyms: dict[str, str]) -> Column:
    """True where the texts hold the two words of an antonym pair, or where one negates and the rest is alike by half."""
    x, y = canonical(a, synonyms), canonical(b, synonyms)
    has = lambda w, k: F.array_contains(w, k)
    pair = reduce(Column.__or__, [(has(x, p) & has(y, q)) | (has(x, q) & has(y, p)) for p, q in antonyms], F.lit(False))
    bare = lambda w: F.array_distinct(F.filter(w, lambda t: ~t.isin(*NEGATIONS)))
    return pair | ((negates(x) != negates(y)) & (jaccard(bare(x), bare(y)) >= 0.5))


def coherence_of(question: Column, answer: Column) -> Column:
    """0.5, 0.3 where the question ends in a mark, 0.3 where the answer has three words, 0.2 where they share a word; at most 1."""
    q, a = tokens(question), tokens(answer)
    asks, says = F.endswith(F.trim(question), F.lit("?")), F.size(a) >= 3
    score = 0.5 + F.when(asks, 0.3).otherwise(0.0) + F.when(says, 0.3).otherwise(0.0) + F.when(F.arrays_overlap(q, a), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def article_numbers(text: Column, word: str = "ماده") -> Column:
    """The numbers that follow the word, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(word + r"\s+(\d+)"), F.lit(1)), lambda n: n.cast("long"))


def term_spans(docs: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, category, term, start, end) of each category's pattern, without regard to case; offsets in characters."""
    def spans(name: str, pattern: str) -> Column:
        p = F.lit(f"(?i){pattern}")
        hits = F.regexp_extract_all(text_col, p, F.lit(0))
        gaps = F.call_function("split", F.col(text_col), p, F.lit(-1))
        at = F.aggregate(
            F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h")),
            F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,term:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["n"] + F.length(x["g"]) + F.length(x["h"])).alias("n"),
                F.concat(acc["out"], F.array(F.struct((acc["n"] + F.length(x["g"])).alias("start"), x["h"].alias("term")))).alias("out"),
            ),
        )["out"]
        return F.transform(at, lambda s: F.struct(F.lit(name).alias("category"), s["term"].alias("term"), s["start"].alias("start")))

    rows = docs.select(F.col(id_col), F.explode(F.concat(*[spans(n, p) for n, p in categories.items()])).alias("s"))
    return rows.select(id_col, "s.category", "s.term", "s.start", (F.col("s.start") + F.length("s.term")).alias("end"))


def group_coherence(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Per group the mean cosine of its ordered pairs, from the sum of unit vectors; 1 for fewer than two rows."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    u = rows.select(group, F.posexplode(F.transform(vector, lambda v: F.when(size > 0, v / size).otherwise(0.0))).alias("i", "v"))
    per = u.groupBy(group, "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("own"), F.count("*").alias("n"))
    n = F.max("n")
    mean = (F.sum(F.col("s") * F.col("s")) - F.sum("own")) / (n * (n - 1))
    return per.groupBy(group).agg(n.alias("n"), F.when(n < 2, 1.0).otherwise(F.round(mean, 6)).alias("coherence"))


def dead_letters(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds reason: the first check (name -> condition that must hold) that a row fails, null where it passes all."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("reason", reason)


def counterfactual(df: DataFrame, equations: dict[str, Column], do: dict[str, float], evidence: list[str]) -> DataFrame:
    """The intervened model recomputed row by row; evidence columns that it doesn't change keep their observed values."""
    from lumenquarry.operators.models import intervene

    kept = {k: v for k, v in equations.items() if k not in evidence or k in do}
    return intervene(df, kept, do)


def unusual_vectors(rows: DataFrame, id_col: str, vector: str, threshold: float) -> DataFrame:
    """Rows (id, score) whose largest absolute z-score over the components exceeds the threshold.

    Means and deviations are one aggregate per component; the table of them (as wide as a vector) is broadcast.
    """
    x = rows.select(id_col, F.posexplode(vector).alias("i", "v"))
    stats = x.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = x.join(F.broadcast(stats), "i").withColumn("z", F.when(F.col("s") > 0, F.abs((F.col("v") - F.col("m")) / F.col("s"))).otherwise(0.0))
    return z.groupBy(id_col).agg(F.round(F.max("z"), 6).alias("score")).where(F.col("score") > threshold)


def audited_citations(docs: DataFrame, pattern: str, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, cited, exists) of the distinct numbers that the pattern's group finds; known (cited)."""
    found = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)))).alias("c"))
    found = found.select(id_col, F.col("c").cast("long").alias("cited")).distinct()
    return found.join(known.select("cited").distinct().withColumn("exists", F.lit(True)), "cited", "left").fillna(False, ["exists"]).select(id_col, "cited", "exists")


def similar_token_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of rows whose token sets have a Jaccard above the threshold; exact.

    Prefix filter: with tokens in order of rarity, sets that similar share one of the first
    n - ceil(threshold * n) + 1 tokens of each. Only those tokens are joined, so common words cost nothing.
    """
    t = rows.select(F.col(id_col).alias("id"), F.array_distinct(tokens(F.col(text_col))).alias("t")).where(F.size("t") > 0)
    each = t.select("id", F.explode("t").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = each.join(df, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))  # a row's own tokens
    n = F.size("s")
    sets = cut(ranked.select("id", n.alias("n"), F.transform("s", lambda x: x["w"]).alias("t")))
    first = F.slice("t", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1)
    heads = sets.select("id", "n", F.explode(first).alias("w"))
    a, b = (heads.select("w", F.col("id").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    near = a.join(b, "w").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    near = cut(near.select("a", "b").distinct())
    x, y = (sets.select(F.col("id").alias(k), F.col("t").alias(f"t_{k}")) for k in "ab")
    sims = near.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("t_a"), F.col("t_b")).alias("similarity"))
    return sims.where(F.col("similarity") > threshold)


def greedy_kept(ids: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """Ids (id) that a pass in order keeps, if a row goes when an earlier kept one is similar; pairs (a, b), a < b.

    Each round settles the rows whose earlier neighbours are all settled; the rounds follow the longest chain of
    similar rows, not the table.
    """
    state = cut(ids.select("id", F.lit(None).cast("boolean").alias("kept")))
    pairs = cut(pairs.select("a", "b").distinct())
    for _ in range(rounds):
        earlier = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("id")).agg(
            F.max(F.coalesce("k", F.lit(False))).alias("has_kept"), F.max(F.col("k").isNull()).alias("has_open")
        )
        now = state.join(earlier, "id", "left")
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("has_kept"), False).when(~F.coalesce("has_open", F.lit(False)), True)
        state = cut(now.select("id", settled.alias("kept")))
        if state.where("kept is null").isEmpty():
            return state.where("kept").select("id")
    raise RuntimeError(f"not settled after {rounds} rounds")


def similar_vector_pairs(vectors: DataFrame, id_col: str, vector: str, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b), a < b, with a cosine above the threshold: an exact scan, block by block.

    Every two blocks of about `block` vectors meet in one task, and only pairs over the threshold leave it; the work
    is quadratic by definition, the memory of a task is two blocks.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("k"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(j, F.col("k")).alias("x"), F.greatest(j, F.col("k")).alias("y")))
    rows = v.withColumn("c", F.explode(cells)).select("c.x", "c.y", "k", "id", "v")

    def run(pdf):
        import pandas as pd

        u = np.array(pdf["v"].tolist(), float)
        size = np.linalg.norm(u, axis=1, keepdims=True)
        u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
        ids, k = pdf["id"].to_numpy(), pdf["k"].to_numpy()
        left, right = k == pdf["x"].iloc[0], k == pdf["y"].iloc[0]
        i, j = np.nonzero(u[left] @ u[right].T > threshold)
        a, b = ids[left][i], ids[right][j]
        keep = a < b if pdf["x"].iloc[0] == pdf["y"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return rows.groupBy("x", "y").applyInPandas(run, "a long, b long")


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """The covariance matrix of some columns and the row count, in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*"), *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    m = np.zeros((len(columns), len(columns)))
    for (i, j), c in zip(pairs, row[1:], strict=True):
        m[i, j] = m[j, i] = c or 0.0
    return m, row[0]


def linear_dag(cov: np.ndarray, penalty: float = 0.05, threshold: float = 0.3, rounds: int = 12, steps: int = 400) -> np.ndarray:
    """Weights of a directed acyclic linear model by continuous optimisation, from the covariance matrix alone.

    Minimises the squared error plus an L1 penalty under tr(exp(W*W)) = d with an augmented Lagrangian, by Adam;
    columns are standardised first. The driver sees a d by d matrix whatever the table's size.
    """
    d = len(cov)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    s = cov / np.outer(scale, scale)
    w, alpha, rho = np.zeros((d, d)), 0.0, 1.0
    eye = np.eye(d)

    def acyclic(w):
        term = total = eye.copy()
        for k in range(1, d + 8):
            term = term @ (w * w) / k
            total = total + term
        return np.trace(total) - d, total.T * 2 * w

    for _ in range(rounds):
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            h, dh = acyclic(w)
            g = s @ (w - eye) + penalty * np.sign(w) + (alpha + rho * h) * dh
            np.fill_diagonal(g, 0.0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        h, _ = acyclic(w)
        alpha, rho = alpha + rho * h, min(rho * 4, 1e8)
        if h < 1e-8:
            break
    w[np.abs(w) < threshold] = 0.0
    return w


def gaussian_process(points: DataFrame, group: str, x: str, y: str, at: list[float], scale: float, noise: float = 0.1, bins: int = 64) -> DataFrame:
    """Rows (group, x, mean, std): a Gaussian process with a squared-exponential kernel, per group.

    The points of a group are first averaged into at most `bins` cells of the x range (one aggregate), whose counts
    divide the noise; so a task inverts a small matrix, whatever the group's size.
    """
    ends = points.groupBy(group).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    cell = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins))
    cells = points.join(ends, group).groupBy(group, cell.alias("cell")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))
    schema = f"{group} {dict(points.dtypes)[group]}, x double, mean double, std double"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("x")
        px, py, n = (pdf[c].to_numpy(float) for c in ("x", "y", "n"))
        kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None, :]) / scale) ** 2)
        k = kernel(px, px) + np.diag(noise / n + 1e-9)
        q = np.array(at, float)
        solved = np.linalg.solve(k, np.column_stack([py - py.mean(), kernel(px, q)]))
        mean = py.mean() + kernel(q, px) @ solved[:, 0]
        var = 1 - np.einsum("ij,ji->i", kernel(q, px), solved[:, 1:])
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(q), "x": q, "mean": np.round(mean, 6), "std": np.round(np.sqrt(np.maximum(var, 0)), 6)})

    return cells.groupBy(group).applyInPandas(run, schema)


def learned_weights(feedback: list[tuple[float, dict[str, float]]], weights: dict[str, float], rate: float = 0.1) -> dict[str, float]:
    """Weights after feedback in order (rating, scores by source): w += rate * (rating - score) * score, then shares of 1;
    the rate falls by a tenth after each hundred.
    """
    w = dict(weights)
    for i, (rating, scores) in enumerate(feedback, 1):
        w = {k: max(0.0, v + rate * (rating - scores.get(k, 0.0)) * scores.get(k, 0.0)) for k, v in w.items()}
        total = math.fsum(w.values()) or 1.0
        w = {k: v / total for k, v in w.items()}
        if i % 100 == 0:
            rate *= 0.9
    return w


def recent(rows: DataFrame, keep: Column, order: list[Column], n: int = 10) -> DataFrame:
    """The last n rows that are kept, by a top-n that every task does for itself first."""
    return rows.where(keep).orderBy(*order).limit(n)


def blended(parts: dict[str, float]) -> Column:
    """Weighted sum of score columns; a missing score is 0."""
    return reduce(Column.__add__, [w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in parts.items()])


def positions_in(window_by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*window_by).orderBy(*order))
