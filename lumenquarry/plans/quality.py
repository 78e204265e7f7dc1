"""Quality, fairness, calibration and causal queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators import quality as Q
from lumenquarry.plans.base import query


def judged(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")


@query("completeness", """
with w as (select count(*) as n, sum(case when ts is null then 1 else 0 end) as ts, sum(case when user_id is null then 1 else 0 end) as user_id,
 sum(case when event_type is null or event_type='' then 1 else 0 end) as event_type, sum(case when value is null or isnan(value) then 1 else 0 end) as value, sum(case when props is null or props='' then 1 else 0 end) as props from events),
l as (select n, feature, missing from w unpivot (missing for feature in (ts, user_id, event_type, value, props)))
select feature, round(1 - missing / n, 6) as completeness, case when missing / n > 0.2 then 'high' when missing / n > 0.05 then 'medium' else 'none' end as severity from l""")
def completeness(t):
    return Q.completeness(t.events, ["ts", "user_id", "event_type", "value", "props"])


@query("consistency", """
select 'l_returnflag' as feature, round(count(distinct l_returnflag) / count(*), 6) as unique_ratio from lineitem
union all select 'l_partkey', round(count(distinct l_partkey) / count(*), 6) from lineitem union all select 'l_quantity', round(count(distinct l_quantity) / count(*), 6) from lineitem""")
def consistency(t):
    cols = ["l_returnflag", "l_partkey", "l_quantity"]
    wide = t.lineitem.agg(*[F.round(F.countDistinct(c) / F.count("*"), 6).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "unique_ratio")


@query("outliers", """
with f as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
select event_type, count(*) as n, cast(sum(case when value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) then 1 else 0 end) as bigint) as outliers from events join f using (event_type) group by 1""")
def outliers(t):
    return Q.outliers(t.events, "value", "event_type")


@query("validity", "select round(avg(case when l_discount between 0 and 0.08 then 1.0 else 0 end), 6) as discount_ok, round(avg(case when l_quantity between 1 and 45 then 1.0 else 0 end), 6) as quantity_ok from lineitem")
def validity(t):
    ok = lambda c, a, b: F.round(F.avg(F.col(c).between(a, b).cast("double")), 6)
    return t.lineitem.agg(ok("l_discount", 0, 0.08).alias("discount_ok"), ok("l_quantity", 1, 45).alias("quantity_ok"))


@query("quality_score", """
with c as (select 1 - avg(case when value is null then 1.0 else 0 end) as c from events), f as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
k as (select 1 - avg(case when value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) then 1.0 else 0 end) as k from events, f), v as (select avg(case when value between 0 and 100 then 1.0 else 0 end) as v from events)
select round(0.4 * c + 0.3 * k + 0.3 * v, 6)::double as score from c, k, v""")
def quality_score(t):
    e = t.events.join(F.broadcast(Q.fences(t.events, "value")))  # one row of fences
    share = lambda x: F.avg(x.cast("double"))
    inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    return e.agg(F.round(0.4 * share(F.col("value").isNotNull()) + 0.3 * share(inside) + 0.3 * share(F.col("value").between(0, 100)), 6).alias("score"))


@query("drift_ks", """
with x as (select l_extendedprice as x, l_shipdate < timestamp '1995-06-17' as r from lineitem), p as (select x, sum(r::int) as r, sum((not r)::int) as c from x group by x),
g as (select abs(sum(r) over (order by x) / sum(r) over () - sum(c) over (order by x) / sum(c) over ()) as gap from p) select round(max(gap), 6) as ks from g""")
def drift_ks(t):
    return Q.ks_statistic(t.lineitem, "l_extendedprice", F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz"))


@query("drift_chi_square", """
with p as (select l_returnflag as x, sum((l_shipdate < timestamp '1995-06-17')::int) as r, sum((l_shipdate >= timestamp '1995-06-17')::int) as c from lineitem group by 1),
e as (select c, r * sum(c) over () / sum(r) over () as e from p) select round(sum(case when e > 0 then (c - e) * (c - e) / e end), 4) as chi2, count(*) as categories from e""")
def drift_chi_square(t):
    return Q.chi_square(t.lineitem, "l_returnflag", F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz"))


FAIR = "g as (select lang, count(*) as n, avg(toxic::double) as rate, avg(case when quality=1 then toxic::double end) as tpr, avg(case when quality=0 then toxic::double end) as fpr from labels join documents using (doc_id) group by 1)"


@query("fairness_rates", f"with {FAIR} select lang, n, round(rate, 6) as rate, round(tpr, 6) as tpr, round(fpr, 6) as fpr from g")
def fairness_rates(t):
    r = Q.group_rates(judged(t), "lang", "toxic", "quality")
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("rate", "tpr", "fpr")])


@query("fairness_scores", f"""with {FAIR}, s as (select max(rate)-min(rate) as r, coalesce(max(tpr)-min(tpr),0) as t, coalesce(max(fpr)-min(fpr),0) as f from g)
select round(1-r, 6) as demographic_parity, round(1-(t+f)/2, 6) as equalized_odds, round(1-t, 6) as equal_opportunity,
 case when least(1-r, 1-(t+f)/2) < 0.5 then 'critical' when least(1-r, 1-(t+f)/2) < 0.8 then 'medium' else 'low' end as severity from s""")
def fairness_scores(t):
    return Q.fairness(judged(t), "lang", "toxic", "quality")


@query("disparate_impact", "select round(avg(case when lang<>'en' then toxic::double end) / avg(case when lang='en' then toxic::double end), 6) as ratio from labels join documents using (doc_id)")
def disparate_impact(t):
    rate = lambda c: F.avg(F.when(c, F.col("toxic").cast("double")))
    return judged(t).agg(F.round(rate(F.col("lang") != "en") / rate(F.col("lang") == "en"), 6).alias("ratio"))


@query("calibration_ece", """
with b as (select greatest(ceil(l_discount * 10 * 10 / 10), 1) as bin, l_discount as conf, (l_returnflag = 'R')::int::double as ok from lineitem), p as (select bin, count(*) as n, abs(avg(conf) - avg(ok)) as gap from b group by 1)
select round(sum(n * gap) / sum(n), 6) as ece from p""")
def calibration_ece(t):
    return Q.expected_calibration_error(t.lineitem, F.col("l_discount"), F.col("l_returnflag") == "R")


@query("conformal_width", """
with e as (select abs(value-50) as e, row_number() over (order by abs(value-50)) as r, count(*) over () as n from events), p as (select max(n) as n, (max(n)-1)*least(1.0, ceil((max(n)+1)*0.9)/max(n)) as pos from e),
b as (select pos, a.e as lo, c.e as hi from p join e a on a.r = floor(pos)+1 join e c on c.r = least(p.n, floor(pos)+2)) select round(lo + (pos-floor(pos))*(hi-lo), 6) as width from b""")
def conformal_width(t):
    return Q.conformal_width(t.events, F.col("value"), F.lit(50.0))


@query("ensemble_uncertainty", """
select user_id, round(avg(value), 6) as mean, round(case when count(*) < 2 then 0.5 else var_pop(value) end, 4) as epistemic, round(case when count(*) < 2 then 0 else 0.5 * stddev_pop(value) end, 4)::double as aleatoric,
 round(case when count(*) < 2 then 0.5 else sqrt(var_pop(value) * var_pop(value) + 0.25 * var_pop(value)) end, 4) as total from events group by 1""")
def ensemble_uncertainty(t):
    return Q.ensemble(t.events, "user_id", "value")


@query("prediction_interval", "select event_type, round(avg(value) - 1.96 * stddev_pop(value), 4) as low, round(avg(value) + 1.96 * stddev_pop(value), 4) as high from events group by 1")
def prediction_interval(t):
    m, s = F.avg("value"), F.stddev_pop("value")
    return t.events.groupBy("event_type").agg(F.round(m - 1.96 * s, 4).alias("low"), F.round(m + 1.96 * s, 4).alias("high"))


@query("noisy_or", "select l_suppkey, round(1 - product(1 - l_discount / 100), 6) as p from lineitem group by 1")
def noisy_or(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(Q.noisy_or(F.col("l_discount") / 100), 6).alias("p"))


@query("paired_t_test", """
with p as (select l_extendedprice * (1 - l_discount) as a, l_extendedprice as b from lineitem), s as (select count(*) as n, avg(a-b) as m, stddev_samp(a-b) as sd, var_pop(a) as va, var_pop(b) as vb from p)
select n, round(m, 4) as mean_difference, round(m / (sd / sqrt(n)), 4) as t, round(abs(m / sqrt((va+vb)/2)), 4) as effect,
 case when abs(m / sqrt((va+vb)/2)) < 0.2 then 'negligible' when abs(m / sqrt((va+vb)/2)) < 0.5 then 'small' when abs(m / sqrt((va+vb)/2)) < 0.8 then 'medium' else 'large' end as interpretation from s""")
def paired_t_test(t):
    return Q.paired_t(t.lineitem, F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"))


@query("signed_rank", """
with d as (select abs(o_custkey % 97 - o_orderkey % 89) as x, sign(o_custkey % 97 - o_orderkey % 89) as s from orders), p as (select x, count(*) as n, sum((s > 0)::int) as pos from d where x <> 0 group by 1),
r as (select n, pos, coalesce(sum(n) over (order by x rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rank from p)
select round(sum(rank * pos), 2)::double as w_plus, round(sum(rank * (n - pos)), 2)::double as w_minus from r""")
def signed_rank(t):
    return Q.signed_rank(t.orders, F.col("o_custkey") % 97 - F.col("o_orderkey") % 89)


CAUSAL = "x as (select o_orderkey, o_totalprice as y, (c_mktsegment = 'BUILDING')::int as treated, 0.1 + 0.8 * ((o_custkey % 100) / 100.0)::double as e from orders join customer on o_custkey = c_custkey)"


def causal(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"))
    return t.orders.join(c, "o_custkey").select("o_orderkey", F.col("o_totalprice").alias("y"), "treated", (0.1 + 0.8 * ((F.col("o_custkey") % 100) / 100.0)).alias("e"))


@query("causal_ipw", f"""with {CAUSAL}, w as (select treated / e as w1, (1 - treated) / (1 - e) as w0, y from x)
select round(sum(w1 * y) / sum(w1) - sum(w0 * y) / sum(w0), 4) as ate from w""")
def causal_ipw(t):
    return Q.ipw_ate(causal(t), F.col("treated"), F.col("y"), F.col("e"))


@query("causal_aipw", f"""with {CAUSAL}, m as (select avg(case when treated=1 then y end) as m1, avg(case when treated=0 then y end) as m0 from x),
p as (select (treated * (y - m1) / e + m1) - ((1 - treated) * (y - m0) / (1 - e) + m0) as p from x, m) select round(avg(p), 4) as ate, round(stddev_pop(p) / sqrt(count(*)), 4) as se from p""")
def causal_aipw(t):
    x = causal(t)
    m = x.agg(F.avg(F.when(F.col("treated") == 1, F.col("y"))).alias("m1"), F.avg(F.when(F.col("treated") == 0, F.col("y"))).alias("m0"))
    return Q.aipw_ate(x.join(F.broadcast(m)), F.col("treated"), F.col("y"), F.col("e"), F.col("m1"), F.col("m0"))  # one row of means


@query("causal_matching", """
with c as (select c_custkey as id, c_acctbal as p, c_mktsegment = 'BUILDING' as t from customer),
n as (select a.id as t_id, b.id as c_id, round(abs(a.p - b.p), 4) as gap, row_number() over (partition by a.id order by abs(a.p - b.p), b.id) as rank from c a join c b on abs(a.p - b.p) <= 25 where a.t and not b.t)
select t_id, c_id, gap, rank from n where rank <= 2""")
def causal_matching(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("p"), (F.col("c_mktsegment") == "BUILDING").alias("t"))
    m = Q.nearest_matches(c.where("t"), c.where("not t"), 25.0, 2)
    return m.select("t_id", "c_id", F.round("gap", 4).alias("gap"), F.col("rank").cast("long").alias("rank"))


@query("bootstrap_interval", """
with u as (select draw, value, cast(('0x' || substr(md5('boot:' || draw || ':' || event_id), 1, 12)) as bigint) / 281474976710656.0 as u from events, range(50) r(draw)),
m as (select draw, value, (select count(*) from (values (0.36787944117144233), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462), (0.9963401531726563), (0.9994058151824183), (0.9999167588507119)) c(x) where u >= x) as k from u),
d as (select draw, sum(k * value) / sum(k) as mean from m group by 1) select round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from d""")
def bootstrap_interval(t):
    b = Q.seeded_bootstrap(t.events, "event_id", "value", 50, "boot")
    return b.agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


@query("correlation_partial", """
with c as (select corr(l_quantity, l_extendedprice) as xy, corr(l_quantity, l_tax) as xz, corr(l_extendedprice, l_tax) as yz from lineitem)
select round(xy, 6) as r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as partial from c""")
def correlation_partial(t):
    c = t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("xy"), F.corr("l_quantity", "l_tax").alias("xz"), F.corr("l_extendedprice", "l_tax").alias("yz"))
    partial = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    return c.select(F.round("xy", 6).alias("r"), F.round(partial, 6).alias("partial"))


@query("temperature_softmax", """
with x as (select vec_id, list_transform(embedding[1:4], lambda v: exp(v::double / 2)) as e from embeddings) select vec_id, round(e[1] / list_sum(e), 6) as p0, round(e[4] / list_sum(e), 6) as p3 from x""")
def temperature_softmax(t):
    x = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: F.exp(v.cast("double") / 2)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", F.round(F.get("e", 0) / total, 6).alias("p0"), F.round(F.get("e", 3) / total, 6).alias("p3"))


@query("score_features", "select event_id, round(value*value, 4) as s2, round(value*value*value, 2) as s3, round(sqrt(abs(value)+1e-10), 6) as root, round(ln(abs(value)+1e-10), 6) as log from events where value is not null")
def score_features(t):
    v = F.col("value")
    return t.events.where(v.isNotNull()).select("event_id", F.round(v * v, 4).alias("s2"), F.round(v * v * v, 2).alias("s3"), F.round(F.sqrt(F.abs(v) + 1e-10), 6).alias("root"), F.round(F.log(F.abs(v) + 1e-10), 6).alias("log"))


@query("entity_merge", """
with e as (select lower(regexp_extract(p_name, '^(\\S+)', 1)) as norm, p_brand as label, p_retailprice as score, p_type as source from part)
select norm, label, max(score) as score, string_agg(distinct source, '+' order by source) as sources, count(*) as n from e group by 1, 2""")
def entity_merge(t):
    e = t.part.select(F.lower(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("norm"), F.col("p_brand").alias("label"), F.col("p_retailprice").alias("score"), F.col("p_type").alias("source"))
    return e.groupBy("norm", "label").agg(F.max("score").alias("score"), F.concat_ws("+", F.array_sort(F.collect_set("source"))).alias("sources"), F.count("*").alias("n"))


@query("evidence_confidence", "select l_suppkey, round(least(1, avg(1 - l_discount) * (0.7 + 0.3 * least(count(*) / 5, 1))), 6) as confidence from lineitem group by 1")
def evidence_confidence(t):
    c = F.avg(1 - F.col("l_discount")) * (0.7 + 0.3 * F.least(F.count("*") / 5, F.lit(1.0)))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.least(F.lit(1.0), c), 6).alias("confidence"))


@query("sla_compliance", """
with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events)
select event_type, count(*) as n, round(avg(case when value <= 50 then 1.0 else 0 end), 6) as compliance, round(quantile_cont(value, 0.95), 6) as p95 from r where rn <= 1000 group by 1""")
def sla_compliance(t):
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("rn", rn).where("rn <= 1000").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") <= 50).cast("double")), 6).alias("compliance"), F.round(F.percentile("value", 0.95), 6).alias("p95"))
