"""Operators that need a model or an order: causal structure, interventions, centrality by paths, replay, boundaries.

Grouped pandas is used only where a sequence or a whole small graph is the unit of work.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """All pairwise correlations and the row count, in one aggregate."""
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(F.count("*"), *[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    m = np.eye(len(columns))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        m[i, j] = m[j, i] = 0.0 if v is None or math.isnan(v) else v
    return m, row[0]


def partial_correlation(m: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """Correlation of i and j with the given variables held, from the inverse of their correlation matrix."""
    at = [i, j, *given]
    p = np.linalg.pinv(m[np.ix_(at, at)])
    return float(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1])) if p[0, 0] > 0 and p[1, 1] > 0 else 0.0


def skeleton(m: np.ndarray, n: int, alpha: float = 0.05, most: int = 2) -> list[tuple[int, int]]:
    """Undirected edges of the PC algorithm: drop those that are independent given some neighbours (Fisher's z)."""
    from statistics import NormalDist

    limit = NormalDist().inv_cdf(1 - alpha / 2)
    near = {i: {j for j in range(len(m)) if j != i} for i in range(len(m))}
    for size in range(most + 1):
        for i, j in combinations(range(len(m)), 2):
            if j not in near[i]:
                continue
            for given in combinations(sorted(near[i] - {j}), size):
                r = max(-0.999999, min(0.999999, partial_correlation(m, i, j, given)))
                if abs(0.5 * math.log((1 + r) / (1 - r))) * math.sqrt(max(n - size - 3, 1)) < limit:
                    near[i].discard(j)
                    near[j].discard(i)
                    break
    return [(i, j) for i in near for j in sorted(near[i]) if i < j]


def intervene(df: DataFrame, equations: dict[str, Column], do: dict[str, float]) -> DataFrame:
    """Recompute a structural model's columns in order, with the intervened ones held at constants."""
    for name, equation in equations.items():
        df = df.withColumn(name, F.lit(float(do[name])) if name in do else equation)
    for name in do.keys() - equations.keys():
        df = df.withColumn(name, F.lit(float(do[name])))
    return df


def betweenness(edges: DataFrame, part: str) -> DataFrame:
    """Rows (part, id, betweenness, closeness) of undirected graphs, one per value of `part`, small by contract (Brandes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            if s != d:
                near.setdefault(s, set()).add(d)
                near.setdefault(d, set()).add(s)
        score, close = dict.fromkeys(near, 0.0), {}
        for s in near:
            order, before, paths, far = [], {v: [] for v in near}, dict.fromkeys(near, 0.0), {s: 0}
            paths[s], queue = 1.0, [s]
            for v in queue:
                order.append(v)
                for w in sorted(near[v]):
                    if w not in far:
                        far[w] = far[v] + 1
                        queue.append(w)
                    if far[w] == far[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            total = sum(far.values())
            close[s] = (len(far) - 1) / total if total else 0.0
            share = dict.fromkeys(near, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w] / 2
        ids = sorted(near)
        return pd.DataFrame({part: [pdf[part].iloc[0]] * len(ids), "id": ids, "betweenness": [round(score[i], 6) for i in ids], "closeness": [round(close[i], 6) for i in ids]})

    return edges.select(part, "src", "dst").groupBy(part).applyInPandas(run, f"{part} {dict(edges.dtypes)[part]}, id long, betweenness double, closeness double")


def replay(changes: DataFrame, key: str, order: str, action: str, payload: str, expected: str) -> DataFrame:
    """Replay each entity's changes in order: final hash chain and whether it equals the recorded one.

    The chain is sha256(previous hash, action, payload); MATCH, MISMATCH, PARTIAL (no record) or EMPTY (deleted).
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a"), F.col(payload).cast("string").alias("p"))))
    g = changes.groupBy(key).agg(steps.alias("s"), F.max_by(expected, order).alias("want"))
    chain = F.aggregate("s", F.lit(""), lambda acc, x: F.sha2(F.concat_ws("|", acc, x["a"], x["p"]), 256))
    gone = F.element_at("s", -1)["a"] == "DELETE"
    state = F.when(gone, "EMPTY").when(F.col("want").isNull(), "PARTIAL").when(F.col("want") == chain, "MATCH").otherwise("MISMATCH")
    return g.select(key, F.size("s").cast("long").alias("steps"), chain.alias("hash"), state.alias("state"))


def semantic_boundaries(parts: DataFrame, key: str, order: str, vector: str, spread: float = 0.5, least: int = 2, most: int = 8) -> DataFrame:
    """Rows (key, order, chunk): a new chunk where similarity to the part before falls under mean - spread * deviation.

    Chunks have `least` to `most` parts; the rule is sequential, so a key's parts are one group.
    """
    schema = f"{key} {dict(parts.dtypes)[key]}, {order} {dict(parts.dtypes)[order]}, chunk long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.array(pdf[vector].tolist(), float)
        size = np.linalg.norm(x, axis=1)
        sims = (x[1:] * x[:-1]).sum(axis=1) / np.maximum(size[1:] * size[:-1], 1e-12)
        limit = sims.mean() - spread * sims.std() if len(sims) else 0.0
        chunk, held, out = 0, 0, []
        for i in range(len(x)):
            if i and held >= least and (held >= most or sims[i - 1] < limit):
                chunk, held = chunk + 1, 0
            held += 1
            out.append(chunk)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "chunk": out})

    return parts.select(key, order, vector).groupBy(key).applyInPandas(run, schema)


def augmented(docs: DataFrame, synonyms: dict[str, str], ratio: float, seed: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with about `ratio` of their known words swapped: a word is taken by a hash of (seed, id, place), so reruns agree."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    digest = lambda i: F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), i.cast("string")))
    draw = lambda i: F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("long") < int(2**32 * ratio)
    words = F.transform(F.split(F.col(text_col), " ", -1), lambda w, i: F.when(draw(i), F.coalesce(F.try_element_at(table, w), w)).otherwise(w))
    return docs.select(id_col, F.concat_ws(" ", words).alias(text_col))


def rerank(candidates: DataFrame, group: str, score: Column, stage1: int, stage2: int, rescored: Column, tie: str) -> DataFrame:
    """Two-stage top-k: the stage-1 best by `score`, then the stage-2 best of those by `rescored` (a model's column)."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), tie))
    rows = candidates.withColumn("__1", first).where(F.col("__1") <= stage1)
    second = F.row_number().over(Window.partitionBy(group).orderBy(rescored.desc(), tie))
    return rows.withColumn("rank", second.cast("long")).where(F.col("rank") <= stage2).drop("__1")


def fit_temperature(logits: DataFrame, steps: int = 60) -> float:
    """Temperature that minimises the log loss of (logit, label) rows: a one-dimensional search over aggregates.

    Rows are summed into 200 bins of the logit first, so the search never reads the table again.
    """
    bins = logits.groupBy(F.round(F.col("logit") * 20).alias("b")).agg(F.sum("label").alias("y"), F.count("*").alias("n")).collect()
    z, y, n = (np.array([float(r[c]) for r in bins]) for c in ("b", "y", "n"))
    z = z / 20

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-z / t)), 1e-12, 1 - 1e-12)
        return float(-(y * np.log(p) + (n - y) * np.log(1 - p)).sum())

    low, high = 0.05, 20.0
    for _ in range(steps):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2
