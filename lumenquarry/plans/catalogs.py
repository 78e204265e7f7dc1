"""Graph-catalog style queries: overlap retrieval, duplicates and their merge, influence, checks, propensity, tests."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators import graph as G
from lumenquarry.operators import retrieval as R
from lumenquarry.plans.base import query
from lumenquarry.plans.graph import nodes_of, supply
from lumenquarry.plans.retrieval import DENSE_SQL, dense, label_judgements, vector_queries, vectors


@query("metrics_aggregate", f"""with {DENSE_SQL}, q as (select a.vec_id as query_id, count(*) as rel from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1),
h as (select d.query_id, count(*) as hits from dense d join embeddings a on a.vec_id = d.query_id join embeddings b on b.vec_id = d.vec_id and a.label = b.label where d.rank <= 10 group by 1),
m as (select coalesce(hits, 0) / rel as recall from q left join h using (query_id)) select round(avg(recall), 6) as mean_recall, round(stddev_pop(recall), 6) as std_recall, count(*) filter (where recall > 0) as with_results from m""")
def metrics_aggregate(t):
    runs, relevant = label_judgements(t, dense(t).where("rank <= 10"))
    hits = runs.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("hits"))
    m = relevant.join(hits, "query_id", "left").select((F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"))
    return m.agg(F.round(F.avg("r"), 6).alias("mean_recall"), F.round(F.stddev_pop("r"), 6).alias("std_recall"), F.count_if(F.col("r") > 0).alias("with_results"))


@query("entity_overlap_retrieval", """
with q as (select distinct l_partkey from lineitem where l_orderkey in (select min(o_orderkey) + 2 from orders)), s as (select l_suppkey, count(distinct l_partkey) as shared from lineitem where l_partkey in (select l_partkey from q) group by 1)
select l_suppkey, shared, round(shared / (select count(*) from q), 6) as score from s where shared >= 1""")
def entity_overlap_retrieval(t):
    first = t.orders.agg((F.min("o_orderkey") + 2).alias("l_orderkey"))
    q = t.lineitem.join(F.broadcast(first), "l_orderkey").select("l_partkey").distinct()  # one order's parts
    n = F.broadcast(q.agg(F.count("*").alias("n")))
    s = t.lineitem.join(F.broadcast(q), "l_partkey").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("shared")).join(n)
    return s.select("l_suppkey", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("score"))


@query("citation_network_retrieval", """
with e as (select distinct l_suppkey + 1000000 as src, l_partkey as dst from lineitem), u as (select src, dst from e union select dst, src from e),
p1 as (select 1000001::bigint as a, dst as id from u where src = 1000001), p2 as (select p1.id as via, u.dst as id from p1 join u on u.src = p1.id where u.dst <> 1000001)
select id, 1 as hops, round(count(*) / 2, 6) as score from p1 group by 1 union all select id, 2, round(count(*) / 3, 6) from p2 group by 1""")
def citation_network_retrieval(t):
    u = G.both_ways(supply(t))
    seed = t.supplier.where("s_suppkey = 1").select((F.col("s_suppkey") + 1000000).alias("id"))
    p = G.paths(u, seed, 2)
    return p.groupBy(F.element_at("path", -1).alias("id"), "hops").agg(F.round(F.count("*") / (F.col("hops") + 1), 6).alias("score"))


@query("entity_duplicates", "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_type = b.p_type and a.p_name = b.p_name and a.p_partkey < b.p_partkey")
def entity_duplicates(t):
    a, b = (t.part.select("p_type", "p_name", F.col("p_partkey").alias(k)) for k in "ab")
    return a.join(b, ["p_type", "p_name"]).where("a < b").select("a", "b")


@query("entity_duplicates_merge", """
with m as (select p_partkey, min(p_partkey) over (partition by p_type, p_brand, p_size) as keep from part) select keep as p_partkey, count(distinct l_orderkey) as orders, count(distinct m.p_partkey) as merged from m join lineitem on l_partkey = m.p_partkey group by 1""")
def entity_duplicates_merge(t):
    """The smallest id of equal entities stays; edges are redirected to it. The group is found by an aggregate, not a window."""
    keep = t.part.groupBy("p_type", "p_brand", "p_size").agg(F.min("p_partkey").alias("keep"))
    m = t.part.join(keep, ["p_type", "p_brand", "p_size"]).select("p_partkey", "keep")
    x = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(m, "p_partkey")
    return x.groupBy(F.col("keep").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("p_partkey").alias("merged"))


@query("influence", "select l_partkey, count(*) as citations, round(0.5 * count(*) + 50 * avg(l_discount), 6)::double as influence from lineitem group by 1")
def influence(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("citations"), F.round(0.5 * F.count("*") + 50 * F.avg("l_discount"), 6).alias("influence"))


@query("citation_anomaly", """
with e as (select distinct l_suppkey + 1000000 as src, l_partkey as dst from lineitem) select dst as id, count(*) as cited from e where dst not in (select src from e) group by 1 having count(*) >= 2""")
def citation_anomaly(t):
    d = G.degrees(supply(t))
    return d.where("out_degree = 0 and in_degree >= 2").select("id", F.col("in_degree").alias("cited"))


@query("similar_by_neighbors", """
with e as (select distinct l_suppkey as s, l_partkey as p from lineitem), d as (select s, count(*) as n from e group by 1), i as (select a.s as a, b.s as b, count(*) as i from e a join e b on a.p = b.p and a.s <> b.s where a.s % 20 = 0 group by 1, 2)
select a, b, round(i / (x.n + y.n - i), 6) as jaccard from i join d x on x.s = a join d y on y.s = b""")
def similar_by_neighbors(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    d = e.groupBy("s").agg(F.count("*").alias("n"))
    i = e.where("s % 20 = 0").withColumnRenamed("s", "a").join(e.withColumnRenamed("s", "b"), "p").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("i"))
    i = i.join(d.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(d.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    return i.select("a", "b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("jaccard"))


@query("future_dates", "select count(*) as n from lineitem where l_shipdate > timestamp '1998-08-02'")
def future_dates(t):
    return t.lineitem.where(F.col("l_shipdate") > F.lit("1998-08-02").cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@query("fill_word_counts", r"select doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))::bigint as words from documents")
def fill_word_counts(t):
    from lumenquarry.functions.text import tokens

    return t.documents.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("words"))


@query("duplicate_relations", """
with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) select l_orderkey, l_linenumber from r where rn > 1""")
def duplicate_relations(t):
    rn = F.row_number().over(Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("rn", rn).where("rn > 1").select("l_orderkey", "l_linenumber")


@query("batch_upsert", """
with base as (select n_nationkey as k, n_name as v from nation), ch as (select n_nationkey + 20 as k, upper(n_name) || '!' as v from nation where n_nationkey < 10) select * from base where k not in (select k from ch) union all select * from ch""")
def batch_upsert(t):
    from lumenquarry.sources.cdc import upsert

    base = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return upsert(base, base.where("k < 10").select((F.col("k") + 20).alias("k"), F.concat(F.upper("v"), F.lit("!")).alias("v")), ["k"])


@query("vector_precedents", """
with c as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as score
 from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id < a.vec_id), r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from c) select * from r where rank <= 10""")
def vector_precedents(t):
    """Earlier vectors only."""
    return R.nearest(vectors(t), vector_queries(t), 10, earlier=True)


@query("ab_test", """
with p as (select lang, avg(case when quality = 1 then 1.0 else 0 end) as a, avg(case when toxic = 0 then 1.0 else 0 end) as b from labels join documents using (doc_id) group by 1) select count(*) as metrics, count(*) filter (where b > a) as better, count(*) filter (where b > a) > count(*) / 2 as deploy from p""")
def ab_test(t):
    p = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg((F.col("quality") == 1).cast("double")).alias("a"), F.avg((F.col("toxic") == 0).cast("double")).alias("b"))
    better = F.count_if(F.col("b") > F.col("a"))
    return p.agg(F.count("*").alias("metrics"), better.alias("better"), (better > F.count("*") / 2).alias("deploy"))


@query("propensity_logistic")
def propensity_logistic(t):
    """Propensities by regularised logistic regression, then the inverse-propensity effect."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from lumenquarry.operators.quality import ipw_ate

    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("label"), "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    x = VectorAssembler(inputCols=["c_acctbal", "n"], outputCol="features").transform(c)
    model = LogisticRegression(regParam=0.01, maxIter=20).fit(x)
    p = model.transform(x).select("o_custkey", "label", vector_to_array("probability")[1].alias("p"))
    return ipw_ate(t.orders.join(p, "o_custkey"), F.col("label"), F.col("o_totalprice"), F.col("p"))


@query("subgraph_k_hop", """
with e as (select distinct l_suppkey + 1000000 as src, l_partkey as dst from lineitem), u as (select src, dst from e union select dst, src from e), b as (select 1000001::bigint as id union select dst from u where src = 1000001)
select src, dst from e where src in (select id from b) and dst in (select id from b)""")
def subgraph_k_hop(t):
    e = supply(t)
    seed = t.supplier.where("s_suppkey = 1").select((F.col("s_suppkey") + 1000000).alias("id"))
    return G.induced(e, G.bfs(e, seed, 1, directed=False))


@query("graph_hubs", """
with e as (select distinct l_suppkey + 1000000 as src, l_partkey as dst from lineitem), u as (select src, dst from e union select dst, src from e) select src as id, count(*) as degree from u group by 1 order by degree desc, id limit 20""")
def graph_hubs(t):
    return G.both_ways(supply(t)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(20)


@query("graph_component_count", "select count(distinct n_regionkey) as components from nation")
def graph_component_count(t):
    e = t.nation.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"))
    return G.components(nodes_of(e), e).agg(F.countDistinct("component").alias("components"))
