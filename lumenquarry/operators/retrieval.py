"""Retrieval: BM25 over a postings table, exact vector scan, fusions, diversification, metrics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.functions.text import tokens
from lumenquarry.operators import sparse as S
from lumenquarry.operators import vectors as V
from lumenquarry.operators.graph import cut


#: Terms and queries that are broadcast, at most, after a count; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_QUERIES = 200_000, 10_000
WHOLE = {"byte", "short", "integer", "long"}


def _small(rows: DataFrame, most: int) -> DataFrame:
    """A broadcast side if the rows are few enough, else left to the planner."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, term, tf, dl): the inverted index, one row per document and term."""
    toks = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    terms = toks.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int = 10, docs_id: str = "doc_id", text: str = "text", query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, doc_id, score, rank): the `top` documents of each query; repeated query terms count again.

    Terms of queries (query_id, text) that are few enough go to the workers, which split every text once and score it.
    More terms, or ids that aren't whole numbers, are joined: tokens that no query asks for are dropped before anything
    is shuffled. Corpus statistics are one aggregate. Ties: the smaller id.
    """
    asked = queries.select(query_id, F.explode(tokens(F.col("text"))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    kinds = [docs.schema[docs_id].dataType, queries.schema[query_id].dataType]
    if WHOLE >= {k.typeName() for k in kinds} and (few := V.few(asked.withColumnRenamed(query_id, "query_id"), BROADCAST_TERMS)) is not None:
        rows = docs.select(F.col(docs_id).alias("doc_id"), F.col(text).alias("text"))
        scored = S.bm25(rows, few, k1, b, top)
        scored = scored.select(F.col("query_id").cast(kinds[1]).alias(query_id), F.col("doc_id").cast(kinds[0]).alias("doc_id"), "score")
        return top_k(scored, query_id, "score", "doc_id", top)
    asked = cut(asked)
    toks = docs.select(F.col(docs_id).alias("doc_id"), tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    corpus = toks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = _small(asked.select("term").distinct(), BROADCAST_TERMS)
    hits = toks.select("doc_id", "dl", F.explode("ts").alias("term")).join(wanted, "term").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(df, "term").join(asked, "term").join(F.broadcast(corpus))  # one row of statistics
    scored = scored.groupBy(query_id, "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top_k(scored, query_id, "score", "doc_id", top)


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with rank from 1."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def against_all(rows: DataFrame, queries: DataFrame, among: Column) -> DataFrame:
    """Every row beside every query (with query_id) that `among` allows: a stated query set against all rows.

    Queries are broadcast where their count is at most BROADCAST_QUERIES. More are dealt into blocks of that size by
    a hash of their id; every row goes to each block, so a task holds a block of queries at most.
    """
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return rows.join(F.broadcast(queries), among)
    blocks = -(-2 * n // BROADCAST_QUERIES)
    asked = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "__block").where(among).drop("__block")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, score: Column | None = None, among: Column | None = None, earlier: bool = False) -> DataFrame:
    """Rows (query_id, vec_id, score, rank): exact scan of vectors (vec_id, embedding) for queries (query_id, q).

    queries is a stated set that meets every vector once. A query isn't its own hit; `earlier` takes only vectors of
    smaller ids. Cosines of whole ids are computed in blocks; another `score`, a restriction by `among` or other ids
    go pair by pair.
    """
    whole = WHOLE >= {vectors.schema["vec_id"].dataType.typeName(), queries.schema["query_id"].dataType.typeName()}
    if score is None and among is None and whole:
        scored = V.best(vectors, queries, top, BROADCAST_QUERIES, earlier)
        return top_k(scored, "query_id", "score", "vec_id", top)
    apart = F.col("vec_id") < F.col("query_id") if earlier else F.col("query_id") != F.col("vec_id")
    pairs = against_all(vectors, queries, apart if among is None else apart & among)
    scored = pairs.select("query_id", "vec_id", F.round(score if score is not None else cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top_k(scored, "query_id", "score", "vec_id", top)


def pairs_at_least(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Rows (query_id, vec_id, score) of every query with every vector of another id and a cosine of at least `least`."""
    return V.at_least(vectors, queries, least, BROADCAST_QUERIES)


def cosine_ends(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (low, high): the least and greatest cosine of any query with any vector of another id."""
    return V.ends(vectors, queries, BROADCAST_QUERIES)


def mean_cosine(vectors: DataFrame, embedding: str) -> DataFrame:
    """One row, mean: of the cosines of all ordered pairs, a vector with itself counting 0.

    The pairs' sum is the squared length of the sum of unit vectors less their number; zero vectors add nothing.
    """
    per = V.unit_sums(vectors, embedding).groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    n = F.sum(F.when(F.col("i") == 0, F.col("n")))
    all_rows = vectors.agg(F.count("*").alias("all"))
    return per.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), n.alias("n")).join(F.broadcast(all_rows)).select(((F.col("s2") - F.col("n")) / (F.col("all") * F.col("all"))).alias("mean"))  # one row


def quantized(embedding: Column, words: int = 1) -> Column:
    """One bit a component (1 where it is 0 or more), 64 to a long, first component lowest."""
    def word(k: int) -> Column:
        part = F.slice(embedding, 64 * k + 1, 64)
        bits = F.transform(part, lambda v, i: F.when(v >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.array(*[word(k) for k in range(words)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def ranked_lists(**lists: DataFrame) -> DataFrame:
    """Union of ranked lists (query_id, doc_id, score, rank) with the list's name."""
    return reduce(DataFrame.unionByName, [d.select("query_id", "doc_id", "score", "rank", F.lit(n).alias("list")) for n, d in lists.items()])


def fuse(lists: DataFrame, how: str, k: int = 60, weights: dict[str, float] | None = None, of: int | None = None) -> DataFrame:
    """Rows (query_id, doc_id, score) of ranked lists fused by rrf, borda, combsum, weighted, max or min.

    rrf: sum of 1 / (k + rank). borda: list length minus rank from 0. weighted: weight times score over its list's
    largest. max: the larger raw score. min: the smaller, of documents in every list; of: how many lists there are, empty
    ones too (else those with rows are counted, which computes them once more).
    """
    whole = Window.partitionBy("query_id", "list")
    if how == "rrf":
        part, total = 1 / (k + F.col("rank")), F.sum
    elif how == "borda":
        part, total = (F.count("*").over(whole) - F.col("rank") + 1).cast("double"), F.sum
    elif how == "combsum":
        part, total = F.col("score"), F.sum
    elif how == "weighted":
        weight = reduce(lambda acc, kv: F.when(F.col("list") == kv[0], kv[1]).otherwise(acc), (weights or {}).items(), F.lit(0.0))
        part, total = weight * F.col("score") / F.max("score").over(whole), F.sum
    elif how in ("max", "min"):
        part, total = F.col("score"), F.max if how == "max" else F.min
    else:
        raise ValueError(how)
    fused = lists.withColumn("part", part).groupBy("query_id", "doc_id").agg(total("part").alias("score"), F.count("*").alias("n"))
    if how == "min":
        fused = fused.where(F.col("n") == (lists.select("list").distinct().count() if of is None else of))
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def mmr(candidates: DataFrame, keep: int = 10, balance: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance over candidates (query_id, vec_id, score, embedding), bounded per query by top-k.

    Picks balance * score - (1 - balance) * greatest cosine to a picked one; ties: the smaller id.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        x = np.array(pdf["embedding"].tolist(), float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        near, left, out = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for _ in range(min(keep, len(pdf))):
            value = np.where(left, balance * pdf["score"] - (1 - balance) * near, -np.inf)
            best = int(value.argmax())
            out.append((best, float(value[best])))
            left[best] = False
            near = np.maximum(near, x @ x[best])
        picked = pdf.iloc[[i for i, _ in out]][["query_id", "vec_id"]].copy()
        picked["mmr"] = [round(v, 6) for _, v in out]
        picked["rank"] = range(1, len(out) + 1)
        return picked

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, mmr double, rank long")


def retrieval_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row per query of qrels: recall, precision, reciprocal rank, average precision, nDCG at k (two definitions).

    runs (query_id, doc_id, rank), qrels (query_id, doc_id, rel). precision divides by what was retrieved, not k.
    ndcg has its ideal over all relevant documents, ndcg_retrieved over the retrieved ones only.
    """
    hits = runs.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return judged_metrics(hits, qrels.where("rel > 0").groupBy("query_id", "rel").agg(F.count("*").alias("n")), k)


def judged_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """retrieval_metrics() of runs with their rel and, instead of judgements, their counts (query_id, rel > 0, n).

    An ideal order needs no more than k of each rel, so its rows are bounded whatever the counts are.
    """
    in_order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("found", F.sum((F.col("rel") > 0).cast("int")).over(in_order))
    by_rel = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    hits = hits.withColumn("ideal_rank", by_rel)
    gain = lambda rel, rank: F.col(rel) / F.log2(F.col(rank) + 1)
    at_k = F.col("rank") <= k
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(at_k & (F.col("rel") > 0), 1).otherwise(0)).alias("hits"), F.sum(at_k.cast("int")).alias("retrieved"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") > 0, F.col("found") / F.col("rank"))).alias("ap"),
        F.sum(F.when(at_k, gain("rel", "rank"))).alias("dcg"), F.sum(F.when(F.col("ideal_rank") <= k, gain("rel", "ideal_rank"))).alias("own_ideal"),
    )
    best = relevant.select("query_id", "rel", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"))))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain("rel", "r"))).alias("ideal"))
    ideal = ideal.join(relevant.groupBy("query_id").agg(F.sum("n").alias("relevant")), "query_id")
    rows = ideal.join(got, "query_id", "left")
    safe = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return rows.select(
        "query_id", safe("hits", "relevant").alias("recall"), safe("hits", "retrieved").alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), safe("ap", "relevant").alias("average_precision"),
        safe("dcg", "ideal").alias("ndcg"), safe("dcg", "own_ideal").alias("ndcg_retrieved"),
    )


def search(mode: str, sparse: DataFrame | None = None, dense: DataFrame | None = None, how: str = "weighted", top: int = 10, weights: dict[str, float] | None = None, rerank: Column | None = None) -> DataFrame:
    """Rows (query_id, doc_id, score, rank) of ranked lists: dense, sparse or hybrid, fused by `how`, then rescored by `rerank`.

    dense alone is divided by its best score and kept within 0 and 1; sparse alone keeps its scores.
    """
    if mode == "hybrid":
        scored = fuse(ranked_lists(sparse=sparse, dense=dense), how, weights=weights or {"dense": 0.7, "sparse": 0.3}, of=2)
    elif mode == "dense":
        best = F.max("score").over(Window.partitionBy("query_id"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / best))
        scored = dense.select("query_id", "doc_id", F.round(share, 6).alias("score"))
    elif mode == "sparse":
        scored = sparse.select("query_id", "doc_id", "score")
    else:
        raise ValueError(mode)
    if rerank is not None:
        scored = scored.withColumn("score", rerank)
    return top_k(scored, "query_id", "score", "doc_id", top)
