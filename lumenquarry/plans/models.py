"""Queries of the model-like operators."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators import models as M
from lumenquarry.plans.base import query


@query("causal_skeleton")
def causal_skeleton(t):
    cols = ["l_extendedprice", "l_discount", "revenue", "charge"]
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t.lineitem.withColumn("revenue", revenue).withColumn("charge", F.col("revenue") * (1 + F.col("l_tax")))
    m, n = M.correlation_matrix(rows, cols)
    edges = [(cols[i], cols[j], round(float(m[i, j]), 6)) for i, j in M.skeleton(m, n)]
    return t._spark.createDataFrame(edges, "a string, b string, r double")


@query("causal_intervention", "select o_orderkey, round(0.5 * 1000 + 10, 6) as y, round(2 * (0.5 * 1000 + 10), 6)::double as z from orders".replace("0.5 * 1000 + 10", "(0.5 * 1000 + 10)::double"))
def causal_intervention(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("x"))
    out = M.intervene(rows, {"x": F.col("x"), "y": 0.5 * F.col("x") + 10, "z": 2 * F.col("y")}, {"x": 1000.0})
    return out.select("o_orderkey", F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("graph_betweenness")
def graph_betweenness(t):
    e = t.nation.select(F.lit("world").alias("part"), F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"))
    ring = t.region.select(F.lit("world").alias("part"), (F.col("r_regionkey") + 1000).cast("long").alias("src"), ((F.col("r_regionkey") + 1) % 5 + 1000).cast("long").alias("dst"))
    return M.betweenness(e.unionAll(ring), "part")


@query("mutation_replay", """
with recursive c as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as r, o_orderstatus as a, o_orderkey as p from orders),
h as (select k, r, sha256('|' || a || '|' || p) as h from c where r = 1 union all select c.k, c.r, sha256(h.h || '|' || c.a || '|' || c.p) from h join c on c.k = h.k and c.r = h.r + 1)
select k, max(r) as steps, arg_max(h, r) as hash, case when k % 3 = 0 then 'PARTIAL' when k % 3 = 1 then 'MISMATCH' else 'MATCH' end as state from h group by k""")
def mutation_replay(t):
    """The recorded hash is absent for a third of the keys, wrong for another and, from a first replay, right for the last."""
    rows = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    first = M.replay(rows.withColumn("want", F.lit(None).cast("string")), "k", "o_orderkey", "o_orderstatus", "o_orderkey", "want")
    want = F.when(F.col("k") % 3 == 1, "wrong").when(F.col("k") % 3 == 2, F.col("hash"))
    recorded = rows.join(first.select("k", want.alias("want")), "k")
    return M.replay(recorded, "k", "o_orderkey", "o_orderstatus", "o_orderkey", "want")


@query("semantic_chunks")
def semantic_chunks(t):
    return M.semantic_boundaries(t.embeddings, "label", "vec_id", "embedding")


@query("augmentation", """
select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: case when cast('0x' || substr(md5('aug:' || doc_id || ':' || (i - 1)), 1, 8) as bigint) < 1288490188 then case w when 'the' then 'that' when 'of' then 'from' when 'and' then 'plus' else w end else w end), ' ') as text from documents""")
def augmentation(t):
    return M.augmented(t.documents, {"the": "that", "of": "from", "and": "plus"}, 0.3, "aug")


@query("two_stage_rerank", """
with f as (select o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r1 from orders), g as (select *, row_number() over (partition by o_custkey order by epoch(o_orderdate) desc, o_orderkey) as rank from f where r1 <= 5)
select o_custkey, o_orderkey, rank from g where rank <= 2""")
def two_stage_rerank(t):
    newest = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return M.rerank(t.orders, "o_custkey", F.col("o_totalprice"), 5, 2, newest, "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("hash_chain_integrity", """
with c as (select o_orderkey, o_custkey, md5(o_orderkey || o_orderstatus) as h, lag(md5(o_orderkey || o_orderstatus)) over (partition by o_custkey order by o_orderkey) as parent, case when o_orderkey % 50 = 0 then 'broken' else lag(md5(o_orderkey || o_orderstatus)) over (partition by o_custkey order by o_orderkey) end as claimed from orders)
select count(*) as broken from c where parent is not null and claimed <> parent""")
def hash_chain_integrity(t):
    h = F.md5(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"))
    parent = F.lag(h).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    c = t.orders.select("o_orderkey", parent.alias("parent"), F.when(F.col("o_orderkey") % 50 == 0, "broken").otherwise(parent).alias("claimed"))
    return c.where("parent is not null and claimed <> parent").agg(F.count("*").alias("broken"))


@query("temperature_fit")
def temperature_fit(t):
    rows = t.labels.select(((F.col("quality") - 0.5) * 4 + (F.col("doc_id") % 7 - 3) / 3).alias("logit"), F.col("quality").alias("label"))
    return t._spark.createDataFrame([(round(M.fit_temperature(rows), 4),)], "temperature double")
