"""Linking, precedent, rewriting, policy and groundedness queries over stand-in tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.functions.text import tokens
from lumenquarry.operators import filters as P
from lumenquarry.operators import linking as K
from lumenquarry.plans.base import query


@query("entity_link", """
with m as (select p_partkey as m_id, p_brand, lower(p_name) as n, p_type as t, regexp_split_to_array(lower(p_name), '\\s+') as w from part where p_partkey % 20 = 0),
c as (select p_partkey as c_id, p_brand, lower(p_name) as n, p_type as t, regexp_split_to_array(lower(p_name), '\\s+') as w from part),
s as (select m_id, c_id, round(0.45 * case when m.n = c.n then 1 when contains(m.n, c.n) or contains(c.n, m.n) then 0.85 else 0.7 * (1 - levenshtein(m.n, c.n) / greatest(length(m.n), length(c.n), 1)) end
 + 0.2 * (m.t = c.t)::int + 0.2 * (m.n = c.n)::int + 0.1 * least(1, 0.5 + 0.1 * len(list_intersect(m.w, c.w))) + 0.05 * starts_with(c.n, substr(m.n, 1, 3))::int, 6)::double as score from m join c on m.p_brand = c.p_brand and m_id <> c_id),
r as (select *, row_number() over (partition by m_id order by score desc, c_id) as rn from s where score >= 0.5) select m_id, c_id, score from r where rn = 1""")
def entity_link(t):
    base = t.part.select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array_distinct(tokens(F.col("p_name"))).alias("tokens"))
    return K.link(base.where("id % 20 = 0").withColumnRenamed("id", "m_id"), base.withColumnRenamed("id", "c_id"), "p_brand", F.col("m_id") != F.col("c_id"))


@query("canonical_ids", "select o_orderkey, case o_orderstatus when 'F' then 'law:' || o_orderkey when 'O' then 'case:' || extract(year from o_orderdate) || '/' || o_orderkey else 'entity:' || o_orderkey end as id from orders")
def canonical_ids(t):
    kind = F.when(F.col("o_orderstatus") == "F", "law").when(F.col("o_orderstatus") == "O", "case").otherwise("other")
    return t.orders.select("o_orderkey", K.canonical_id(kind, F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")).alias("id"))


@query("applicable_rules", r"""
with k as (select distinct item_id as rule_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as k from benchmark), n as (select rule_id, count(*) as n from k group by 1),
f as (select doc_id, kk.k from documents join (select distinct k from k) kk on contains(lower(text), kk.k)), h as (select doc_id as case_id, rule_id, count(*) as h from f join k using (k) group by 1, 2) select case_id, rule_id, round(h / n, 6) as score from h join n using (rule_id)""")
def applicable_rules(t):
    rules = t.benchmark.select(F.col("item_id").alias("rule_id"), F.col("text").alias("condition"))
    return K.applicable_rules(rules, t.documents.select(F.col("doc_id").alias("case_id"), "text"))


@query("similar_precedents", r"""
with c as (select doc_id as case_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as t from documents), q as (select item_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as t from benchmark where item_id % 20 = 0),
s as (select query_id, case_id, round(len(list_intersect(c.t, q.t)) / (len(c.t) + len(q.t) - len(list_intersect(c.t, q.t))), 6) as score from c, q where len(c.t) > 0), r as (select *, row_number() over (partition by query_id order by score desc, case_id) as rank from s where score > 0.05)
select * from r where rank <= 5""")
def similar_precedents(t):
    asked = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return K.similar_precedents(t.documents.select(F.col("doc_id").alias("case_id"), "text"), asked, 0.05)


@query("node_scores", "select l_orderkey, l_linenumber, round(0.4 * (1 - l_discount) + 0.3 * case when l_tax <> 0 then l_tax else l_discount end + 0.3 * l_quantity / 100, 6) as score from lineitem")
def node_scores(t):
    s = K.node_score(1 - F.col("l_discount"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


@query("dispute_severity", "select page_id, greatest(0, least(1, 0.5 + case when regexp_matches(url, 'casino|pills') then 0.3 when regexp_matches(url, 'bets|track') then 0.2 when regexp_matches(url, 'blog') then -0.2 else 0 end))::double as severity from pages")
def dispute_severity(t):
    return t.pages.select("page_id", K.severity(F.col("url"), ["casino", "pills"], ["bets", "track"], ["blog"]).alias("severity"))


@query("query_rewrites", r"""
with v as (select item_id as query_id, replace(text, 'tion', 'sion') as t from benchmark), x as (select query_id, t as variant, 1.0 as c, 'correction' as k from v union all select query_id, regexp_replace(t, '\bthe\b', 'that', 'g'), 0.8, 'synonym' from v
 union all select query_id, regexp_replace(t, '\bthe\b', 'this', 'g'), 0.8, 'synonym' from v union all select query_id, 'what is ' || t, 0.7, 'template' from v),
b as (select query_id, variant, max(c)::double as confidence, arg_max(k, c) as kind from x group by 1, 2) select *, row_number() over (partition by query_id order by confidence desc, variant) as rank from b""")
def query_rewrites(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return K.rewrites(q, [("tion", "sion")], {"the": ["that", "this"]})


@query("policy_filter", """
select o_orderkey from orders where case left(o_orderpriority,1) when '1' then 3 when '2' then 2 when '3' then 1 else 0 end between 0 and 2 and o_totalprice >= 1000 and date_diff('day', o_orderdate::date, date '1998-08-02') <= 900 and o_orderstatus in ('F', 'O')""")
def policy_filter(t):
    level = F.substring("o_orderpriority", 1, 1)
    name = F.when(level == "1", "restricted").when(level == "2", "confidential").when(level == "3", "internal").otherwise("other")
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    ok = P.privacy_rank(name).between(0, 2) & P.compile_filter({"o_totalprice": {"$gte": 1000}, "o_orderstatus": ["F", "O"]}) & (age <= 900)
    return t.orders.where(ok).select("o_orderkey")


@query("legal_filter", """
select l_orderkey, l_linenumber from lineitem where l_linestatus = 'O' and l_returnflag <> 'R' and l_quantity between 10 and 40 and l_shipdate between timestamp '1996-01-01' and timestamp '1997-06-30'""")
def legal_filter(t):
    lo, hi = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")
    keep = P.compile_filter({"l_linestatus": "O", "l_quantity": {"$gte": 10, "$lte": 40}}) & (F.col("l_returnflag") != "R") & F.col("l_shipdate").between(lo, hi)
    return t.lineitem.where(keep).select("l_orderkey", "l_linenumber")


@query("tombstones", "select event_id from events where event_type <> 'error' and event_id not in (select event_id from events where value < 1)")
def tombstones(t):
    gone = t.events.where("value < 1").select("event_id")
    return t.events.where("event_type <> 'error'").join(gone, "event_id", "left_anti").select("event_id")


@query("uncertainty_filter", "select event_id from events where value / 100 < 0.2 and event_type = 'view'")
def uncertainty_filter(t):
    rows = t.events.where("event_type = 'view'").select("event_id", (F.col("value") / 100).alias("u"))
    return P.keep_confident(rows, "u", ["event_id"]).select("event_id")


@query("semantic_threshold", """
select b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id <> 0 and round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= 0.3 order by score desc, b.vec_id limit 5""")
def semantic_threshold(t):
    from lumenquarry.operators.retrieval import dot

    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one vector
    s = t.embeddings.where("vec_id <> 0").join(q).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    return s.where("score >= 0.3").orderBy(F.desc("score"), "vec_id").limit(5)


@query("greedy_semantic_dedup")
def greedy_semantic_dedup(t):
    """Over all vectors, in order of id: a row goes when an earlier kept one has a cosine above a half."""
    from lumenquarry.operators.knowledge import greedy_kept, similar_vector_pairs

    pairs = similar_vector_pairs(t.embeddings, "vec_id", "embedding", 0.5)
    return greedy_kept(t.embeddings.select(F.col("vec_id").alias("id")), pairs).withColumnRenamed("id", "vec_id")


@query("groundedness", r"""
with q as (select conv_id, turn, role, lower(text) as a, lead(lower(text)) over (partition by conv_id order by turn, text) as b from conversations), s as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(a,'\s+'), lambda x: x<>'')) as x, list_distinct(list_filter(regexp_split_to_array(b,'\s+'), lambda x: x<>'')) as y, a, b from q where role='user' and b is not null)
select conv_id, turn, case when contains(a, b) then 1 else round(0.3 * len(list_intersect(x,y))/greatest(len(y),1) + 0.7 * len(list_intersect(x,y))/greatest(len(x)+len(y)-len(list_intersect(x,y)),1), 6) end::double as score from s""")
def groundedness(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    q = t.conversations.select("conv_id", "turn", "role", F.lower("text").alias("a"), F.lead(F.lower("text")).over(w).alias("b")).where("role = 'user' and b is not null")
    x, y = F.array_distinct(tokens(F.col("a"))), F.array_distinct(tokens(F.col("b")))
    i = F.size(F.array_intersect(x, y))
    s = 0.3 * i / F.greatest(F.size(y), F.lit(1)) + 0.7 * i / F.greatest(F.size(x) + F.size(y) - i, F.lit(1))
    return q.select("conv_id", "turn", F.when(F.contains("a", F.col("b")), 1.0).otherwise(F.round(s, 6)).alias("score"))


@query("completeness_score", r"""
with w as (select conv_id, turn, text, list_filter(regexp_split_to_array(lower(text),'\s+'), lambda x: x<>'') as ws, len(regexp_extract_all(text, '[.!?]+')) as s from conversations where role = 'assistant')
select conv_id, turn, round(least(1, case when len(ws) >= 50 then 0.3 when len(ws) >= 20 then 0.2 else 0 end + case when s >= 3 then 0.3 when s >= 1 then 0.2 else 0 end + 0.2 * len(list_distinct(ws)) / greatest(len(ws), 1)), 6)::double as score from w""")
def completeness_score(t):
    ws = tokens(F.col("text"))
    n, marks = F.size(ws), F.size(F.regexp_extract_all("text", F.lit("[.!?]++"), F.lit(0)))
    s = F.when(n >= 50, 0.3).when(n >= 20, 0.2).otherwise(0.0) + F.when(marks >= 3, 0.3).when(marks >= 1, 0.2).otherwise(0.0) + 0.2 * F.size(F.array_distinct(ws)) / F.greatest(n, F.lit(1))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.round(F.least(F.lit(1.0), s), 6).alias("score"))


@query("lexical_difficulty", r"""
with w as (select item_id, length(text) as n, len(regexp_extract_all(text, '[,;]')) as c from benchmark) select item_id, case when n / 600.0 + c / 20.0 >= 0.7 then 'hard' when n / 600.0 + c / 20.0 >= 0.4 then 'medium' else 'easy' end as level from w""")
def lexical_difficulty(t):
    p = F.length("text") / 600.0 + F.size(F.regexp_extract_all("text", F.lit("[,;]"), F.lit(0))) / 20.0
    return t.benchmark.select("item_id", F.when(p >= 0.7, "hard").when(p >= 0.4, "medium").otherwise("easy").alias("level"))


@query("failure_analysis", """
with r as (select o_custkey as q, count(*) as n, sum((o_orderstatus='F')::int) as hits from orders group by 1) select c_custkey, case when n is null then 'no_results' when hits = 0 then 'zero_recall' when hits / n < 0.2 then 'low_precision' else 'ok' end as kind from customer left join r on c_custkey = q""")
def failure_analysis(t):
    r = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("hits"))
    kind = F.when(F.col("n").isNull(), "no_results").when(F.col("hits") == 0, "zero_recall").when(F.col("hits") / F.col("n") < 0.2, "low_precision").otherwise("ok")
    return t.customer.join(r, "c_custkey", "left").select("c_custkey", kind.alias("kind"))


@query("missing_embeddings", "select count(*) as backlog from documents where doc_id not in (select vec_id from embeddings) and length(text) > 0")
def missing_embeddings(t):
    have = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return t.documents.where(F.length("text") > 0).join(have, "doc_id", "left_anti").agg(F.count("*").alias("backlog"))


@query("audit_lines", """
select event_id, 'CEF:0|engine|store|1.0|' || event_type || '|event|' || case when event_type = 'error' then 8 else 3 end || '|suser=' || user_id || ' msg=' || replace(props, '=', '\\=') as line from events""")
def audit_lines(t):
    from lumenquarry.sources.files import cef_line

    level = F.when(F.col("event_type") == "error", 8).otherwise(3)
    return t.events.select("event_id", cef_line("engine", "store", F.col("event_type"), F.lit("event"), level, {"suser": F.col("user_id"), "msg": F.col("props")}).alias("line"))
