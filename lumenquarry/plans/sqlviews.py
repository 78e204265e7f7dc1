"""Analytic views over the relational tables, CDC, catalog and legal-style queries, Merkle roots."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators.ordering import positions
from lumenquarry.functions import hashing as H
from lumenquarry.plans.base import query


@query("view_law_statistics", """
select o_orderstatus, o_orderpriority, count(*) as n, count(*) filter (where o_orderdate >= timestamp '1997-01-01') as recent, round(avg(o_totalprice), 4) as mean, min(o_orderdate) as first, max(o_orderdate) as last from orders where o_totalprice > 0 group by 1, 2""")
def view_law_statistics(t):
    return t.orders.where("o_totalprice > 0").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recent"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("view_citation_network", """
select n_name, count(distinct o_orderkey) as orders, count(distinct case when o_orderstatus='F' then o_orderkey end) as closed, round(avg(o_totalprice), 2) as mean, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments, max(o_orderdate) as last
from nation join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1""")
def view_citation_network(t):
    x = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("closed"), F.round(F.avg("o_totalprice"), 2).alias("mean"),
        F.concat_ws(",", F.array_sort(F.collect_set("c_mktsegment"))).alias("segments"), F.max("o_orderdate").alias("last"))


@query("view_popular", """
with m as (select max(ts) as now_ from events) select user_id, event_type, count(*) as n, max(ts) as last from events, m where ts >= now_ - interval 30 days group by 1, 2 having count(*) >= 5 order by n desc, user_id, event_type limit 1000""")
def view_popular(t):
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))  # one row
    x = t.events.join(now).where(F.col("ts") >= F.col("now") - F.expr("interval 30 days"))
    return x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last")).where("n >= 5").orderBy(F.desc("n"), "user_id", "event_type").limit(1000)


@query("view_job_stats", """
select c_mktsegment, count(distinct c_custkey) as customers, count(distinct case when o_orderstatus='O' then o_orderkey end) as open_orders, round(avg(epoch(max_ship) - epoch(o_orderdate)), 2) as mean_seconds
from customer left join orders on o_custkey = c_custkey left join (select l_orderkey, max(l_shipdate) as max_ship from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def view_job_stats(t):
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    x = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    s = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return x.groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("open_orders"), F.round(F.avg(s("ship") - s("o_orderdate")), 2).alias("mean_seconds"))


@query("view_adapter_stats", "select l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by 1")
def view_adapter_stats(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("view_recent_jobs", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100")
def view_recent_jobs(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("view_job_progress", """
select o_orderkey, count(l_linenumber) as total, count(*) filter (where l_linestatus='F') as done, case when count(l_linenumber)=0 then 0 else round(100.0 * count(*) filter (where l_linestatus='F') / count(l_linenumber), 2) end::double as progress
from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def view_job_progress(t):
    x = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    done, total = F.count_if(F.col("l_linestatus") == "F"), F.count("l_linenumber")
    return x.groupBy("o_orderkey").agg(total.alias("total"), done.alias("done"), F.coalesce(F.round(100.0 * F.try_divide(done, total), 2), F.lit(0.0)).alias("progress"))


@query("view_item_indexed", "select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity = 50) as indexed from part")
def view_item_indexed(t):
    hit = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("indexed", F.lit(True))
    return t.part.select("p_partkey").join(hit, "p_partkey", "left").fillna(False, ["indexed"])


@query("view_backup_statistics", """
select event_type, count(*) as total, count(*) filter (where value >= 20) as ok, round(100.0 * count(*) filter (where value >= 20) / nullif(count(*), 0), 2)::double as rate, round(avg(value), 4) as mean from events group by 1""")
def view_backup_statistics(t):
    ok = F.count_if(F.col("value") >= 20)
    return t.events.groupBy("event_type").agg(F.count("*").alias("total"), ok.alias("ok"), F.round(100.0 * F.try_divide(ok, F.count("*")), 2).alias("rate"), F.round(F.avg("value"), 4).alias("mean"))


@query("view_searchable_chunks", """
select o_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as labels, count(distinct l_partkey) as n from orders left join lineitem on l_orderkey = o_orderkey and l_discount > 0.05 group by 1""")
def view_searchable_chunks(t):
    x = t.orders.select("o_orderkey").join(t.lineitem.where("l_discount > 0.05"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    labels = F.array_sort(F.collect_set("l_returnflag"))
    return x.groupBy("o_orderkey").agg(F.when(F.size(labels) > 0, F.concat_ws(",", labels)).alias("labels"), F.countDistinct("l_partkey").alias("n"))


@query("view_chunk_statistics", "select lang, count(*) as n, round(avg(length(text)), 4) as mean_length, min(length(text))::bigint as shortest, max(length(text))::bigint as longest from documents group by 1")
def view_chunk_statistics(t):
    n = F.length("text").cast("long")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_length"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("view_hourly_performance", """
select date_trunc('hour', ts) as hour, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(count(*) filter (where event_type <> 'error') / count(*), 6) as success,
 sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1""")
def view_hourly_performance(t):
    p = lambda q: F.round(F.percentile("value", q), 6)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    return t.events.groupBy(hour).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("success"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("view_performance_anomalies", """
with h as (select date_trunc('hour', ts) as hour, avg(value) as m, count(*) as n from events group by 1), g as (select avg(m) as gm, stddev_samp(m) as gs, avg(n) as gn from h)
select hour, round(m, 6) as mean, n, case when m > gm + 3 * gs then 'critical' when m > gm + 2 * gs then 'high' when n > 2 * gn then 'volume' end as severity from h, g where m > gm + 2 * gs or n > 2 * gn""")
def view_performance_anomalies(t):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    h = t.events.groupBy(hour).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    g = h.agg(F.avg("m").alias("gm"), F.stddev_samp("m").alias("gs"), F.avg("n").alias("gn"))
    x = h.join(F.broadcast(g))  # one row
    high, volume = F.col("m") > F.col("gm") + 2 * F.col("gs"), F.col("n") > 2 * F.col("gn")
    level = F.when(F.col("m") > F.col("gm") + 3 * F.col("gs"), "critical").when(high, "high").when(volume, "volume")
    return x.where(high | volume).select("hour", F.round("m", 6).alias("mean"), "n", level.alias("severity"))


@query("view_storage_growth", """
select event_type, count(*) as n, round(count(*) / greatest(date_diff('day', min(ts)::date, max(ts)::date), 1), 4) as per_day, round(count(*) + 30 * count(*) / greatest(date_diff('day', min(ts)::date, max(ts)::date), 1), 2) as in_30_days from events group by 1""")
def view_storage_growth(t):
    days = F.greatest(F.datediff(F.max("ts").cast("date"), F.min("ts").cast("date")), F.lit(1))
    n = F.count("*")
    return t.events.groupBy("event_type").agg(n.alias("n"), F.round(n / days, 4).alias("per_day"), F.round(n + 30 * n / days, 2).alias("in_30_days"))


@query("cache_expiry", "select event_id from events where ts + interval 7 days > (select max(ts) from events)")
def cache_expiry(t):
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))  # one row
    return t.events.join(now).where(F.col("ts") + F.expr("interval 7 days") > F.col("now")).select("event_id")


@query("cdc_apply", """
with c as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) select user_id, event_id, event_type from c where rn = 1 and event_type <> 'error'""")
def cdc_apply(t):
    from lumenquarry.sources.cdc import latest

    return latest(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("fair_share_order", "select o_orderkey, row_number() over (order by r, o_custkey, o_orderkey) as position from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders)")
def fair_share_order(t):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return positions(t.orders.withColumn("r", r), ["r", "o_custkey", "o_orderkey"], "position").select("o_orderkey", "position")


@query("priority_order", "select o_orderkey, row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderdate, o_orderkey) as position from orders")
def priority_order(t):
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).cast("long").alias("position"))


@query("state_transitions", """
with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select event_id, coalesce(before, 'start') as before, event_type as after, not (before = 'purchase' and event_type = 'signup') or before is null as valid from l""")
def state_transitions(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = t.events.select("event_id", F.coalesce(before, F.lit("start")).alias("before"), F.col("event_type").alias("after"))
    return x.withColumn("valid", ~((F.col("before") == "purchase") & (F.col("after") == "signup")))


@query("court_hierarchy", """
select o_orderkey, case left(o_orderpriority,1) when '1' then 5 when '2' then 4 when '3' then 3 when '4' then 2 else 1 end as court_rank from orders order by court_rank desc, o_totalprice desc, o_orderkey limit 50""")
def court_hierarchy(t):
    level = F.substring("o_orderpriority", 1, 1)
    rank = F.when(level == "1", 5).when(level == "2", 4).when(level == "3", 3).when(level == "4", 2).otherwise(1)
    return t.orders.withColumn("court_rank", rank).orderBy(F.desc("court_rank"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "court_rank")


@query("active_documents", "select o_orderkey from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def active_documents(t):
    repealed = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus <> 'P'").join(repealed, "o_orderkey", "left_anti").select("o_orderkey")


@query("authority_score", """
select l_partkey, round(sum(case left(o_orderpriority,1) when '1' then 1.0 when '2' then 0.7 else 0.4 end), 4)::double as authority, count(*) as cited from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def authority_score(t):
    level = F.substring("o_orderpriority", 1, 1)
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("l_partkey").agg(F.round(F.sum(F.when(level == "1", 1.0).when(level == "2", 0.7).otherwise(0.4)), 4).alias("authority"), F.count("*").alias("cited"))


@query("temporal_conflicts", """
with p as (select a.o_orderkey as a, b.o_orderkey as b, a.o_orderdate as x, b.o_orderdate as y from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey)
select a, b, case when x > y then a when y > x then b end as winner from p""")
def temporal_conflicts(t):
    o = t.orders
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(k), F.col("o_orderdate").alias(f"d_{k}")) for k in "ab")
    return a.join(b, "o_custkey").where("a < b").select("a", "b", F.when(F.col("d_a") > F.col("d_b"), F.col("a")).when(F.col("d_b") > F.col("d_a"), F.col("b")).alias("winner"))


@query("supersession_chain", """
with recursive r as (select o_orderkey as start, o_orderkey as id, 0 as depth from orders where o_orderkey % 20 = 0 and o_orderkey > 1 union all select start, id // 2, depth + 1 from r where id > 1)
select start, max(depth)::int as depth, arg_max(id, depth) as last from r group by 1""")
def supersession_chain(t):
    from lumenquarry.operators.graph import paths

    e = t.orders.where("o_orderkey > 1").select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 2).alias("dst"))
    p = paths(e, t.orders.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("id")), 64)
    return p.groupBy(F.get("path", 0).alias("start")).agg(F.max("hops").alias("depth"), F.max_by(F.element_at("path", -1), "hops").alias("last"))


@query("audit_trail", """
select o_orderkey, c_name, n_name, count(l_linenumber) as lines from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join lineitem on l_orderkey = o_orderkey group by 1, 2, 3""")
def audit_trail(t):
    x = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.groupBy("o_orderkey", "c_name", "n_name").agg(F.count("l_linenumber").alias("lines"))


@query("cross_store_diff", """
with a as (select n_nationkey, n_name from nation where n_nationkey <> 4), b as (select n_nationkey, case when n_nationkey = 7 then 'X' else n_name end as n_name from nation where n_nationkey <> 9)
select coalesce(a.n_nationkey, b.n_nationkey) as id, case when b.n_nationkey is null then 'missing_right' when a.n_nationkey is null then 'missing_left' else 'changed' end as kind from a full outer join b using (n_nationkey) where a.n_name is distinct from b.n_name""")
def cross_store_diff(t):
    a = t.nation.where("n_nationkey <> 4").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("x"))
    b = t.nation.where("n_nationkey <> 9").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 7, "X").otherwise(F.col("n_name")).alias("y"))
    kind = F.when(F.col("y").isNull(), "missing_right").when(F.col("x").isNull(), "missing_left").otherwise("changed")
    return a.join(b, "id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("id", kind.alias("kind"))


@query("temporal_retrieval", """
with m as (select max(o_orderdate)::date as d from orders) select o_orderkey, round(exp(-date_diff('day', o_orderdate::date, d) / 365), 6) as recency from orders, m where o_orderdate between timestamp '1996-01-01' and timestamp '1997-01-01' and o_orderpriority like '%URGENT%'""")
def temporal_retrieval(t):
    d = F.broadcast(t.orders.agg(F.max("o_orderdate").cast("date").alias("d")))  # one row
    lo, hi = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1996, 1997))
    x = t.orders.where(F.col("o_orderdate").between(lo, hi) & F.contains("o_orderpriority", F.lit("URGENT"))).join(d)
    return x.select("o_orderkey", F.round(F.exp(-F.datediff("d", F.col("o_orderdate").cast("date")) / 365), 6).alias("recency"))


@query("merkle_roots", """
with recursive l as (select n_regionkey as g, sha256(n_name) as h, row_number() over (partition by n_regionkey order by sha256(n_name)) - 1 as pos, 0 as lv, count(*) over (partition by n_regionkey) as n from nation),
a as (select g, list(h order by pos) as hs from l group by g),
r as (select g, hs from a union all select g, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], hs[2 * i + 1]))) from r where len(hs) > 1)
select g as n_regionkey, hs[1] as root from r where len(hs) = 1""")
def merkle_roots(t):
    return H.merkle_root(t.nation, "n_name", "n_regionkey")


@query("merkle_proofs", "select n_regionkey, sha256(n_name) as leaf, true as valid from nation")
def merkle_proofs(t):
    wanted = t.nation.select("n_regionkey", F.sha2("n_name", 256).alias("leaf"))
    p = H.merkle_proof(t.nation, "n_name", "n_regionkey", wanted)
    return p.select("n_regionkey", "leaf", H.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")).alias("valid"))
