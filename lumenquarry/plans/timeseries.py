"""Event-series queries."""

from pyspark.sql import functions as F

from lumenquarry.operators import timeseries as S
from lumenquarry.plans.base import query

ORDER = ["ts", "event_id"]


@query("rolling_stats", """
select event_id, round(avg(value) over w, 6) as r_mean, round(stddev_pop(value) over w, 4) as r_std, min(value) over w as r_min, max(value) over w as r_max, count(value) over w as r_count
from events window w as (partition by event_type order by ts, event_id rows between 19 preceding and current row)""")
def rolling_stats(t):
    r = S.rolling(t.events, "event_type", ORDER, "value", 20)
    return r.select("event_id", F.round("r_mean", 6).alias("r_mean"), F.round("r_std", 4).alias("r_std"), "r_min", "r_max", "r_count")


@query("rolling_last_window", """
with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events)
select event_type, count(*) as n, round(avg(value),6) as mean, round(stddev_pop(value),4) as std, round(quantile_cont(value,0.5),6) as median, round(quantile_cont(value,0.25),6) as p25, round(quantile_cont(value,0.75),6) as p75,
 round(quantile_cont(value,0.95),6) as p95, round(quantile_cont(value,0.99),6) as p99 from r where rn <= 100 group by 1""")
def rolling_last_window(t):
    return S.last_window(t.events, "event_type", ORDER, "value", 100)


@query("anomaly_zscore", """
with h as (select event_id, event_type, value, count(value) over w as n, avg(value) over w as m, stddev_pop(value) over w as s from events window w as (partition by event_type order by ts, event_id rows between 100 preceding and 1 preceding)),
z as (select *, abs((value - m) / s) as z from h where n >= 10 and s > 1e-9)
select event_id, round(z, 4) as z, case when z > 5 then 'critical' when z > 4 then 'high' when z > 3.5 then 'medium' else 'low' end as severity from z where z > 3""")
def anomaly_zscore(t):
    return S.zscore_alerts(t.events, "event_type", ORDER, "value").select("event_id", F.round("z", 4).alias("z"), "severity")


@query("anomaly_iqr", """
with q as (select event_type, quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3, quantile_cont(value,0.5) as med from events group by 1),
m as (select event_type, quantile_cont(abs(value-med),0.5) as mad from events join q using (event_type) group by 1),
b as (select event_id, greatest(q1-value, value-q3)/(q3-q1) as beyond, abs(value-med)/(mad*1.4826) as mad_z from events join q using (event_type) join m using (event_type) where q3 > q1)
select event_id, round(beyond,4) as beyond, round(mad_z,4) as mad_z, case when beyond > 3 then 'critical' when beyond > 2 then 'high' else 'medium' end as severity from b where beyond > 1.5""")
def anomaly_iqr(t):
    return S.iqr_alerts(t.events, "event_type", "value").select("event_id", F.round("beyond", 4).alias("beyond"), F.round("mad_z", 4).alias("mad_z"), "severity")


@query("degradation", """
with x as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r, count(*) over (partition by user_id) as n from events),
g as (select user_id, avg(case when r <= n // 2 then value end) as a, avg(case when r > n // 2 then value end) as b from x group by 1)
select user_id, round(a,6) as first_half, round(b,6) as second_half, round((b-a)/a,6) as rise, case when (b-a)/a > 0.3 then 'critical' when (b-a)/a > 0.2 then 'high' when (b-a)/a > 0.15 then 'medium' else 'none' end as severity from g""")
def degradation(t):
    return S.degradation(t.events, "user_id", ORDER, "value")


@query("trend", """
with s as (select event_type, value, epoch_us(ts) / 1e6 as s from events), g as (select event_type, regr_slope(value, s - 1.7e9) as slope, arg_min(value, (s, value)) as v0, arg_max(value, (s, value)) as v1, min(s) as s0, max(s) as s1 from s group by 1)
select event_type, round(slope * 1e6, 4) as slope_per_million_s, round(case when v0 <> 0 and s1 > s0 then 100 * (v1 - v0) / v0 / (s1 - s0) end * 1e6, 4) as rate_per_million_s from g""")
def trend(t):
    return S.trend(t.events, "event_type", "ts", "value")


@query("rate_limit", """
select event_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as in_window from events""")
def rate_limit(t):
    return S.sliding_count(t.events, "user_id", "ts", 6 * 3600).select("event_id", "in_window")


@query("sessions", """
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events),
i as (select *, sum(case when coalesce(gap,0) > 7200000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as island from g)
select user_id, cast(island as bigint) as island, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from i group by 1, 2""")
def sessions(t):
    return S.islands(t.events, "user_id", "ts", "event_id", 7200)


@query("multi_window_stats", """
select 300 as width_s, event_type, count(*) as windows, max(n) as busiest from (select event_type, time_bucket(interval 5 minutes, ts) as b, count(*) as n from events group by 1,2) group by 2
union all select 3600, event_type, count(*), max(n) from (select event_type, time_bucket(interval 1 hour, ts) as b, count(*) as n from events group by 1,2) group by 2
union all select 86400, event_type, count(*), max(n) from (select event_type, time_bucket(interval 1 day, ts) as b, count(*) as n from events group by 1,2) group by 2""")
def multi_window_stats(t):
    e = t.events.select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    widths = F.explode(F.array(F.lit(300), F.lit(3600), F.lit(86400)))
    per = e.withColumn("width_s", widths).groupBy("width_s", "event_type", F.floor(F.col("s") / F.col("width_s")).alias("b")).agg(F.count("*").alias("n"))
    return per.groupBy("width_s", "event_type").agg(F.count("*").alias("windows"), F.max("n").alias("busiest"))


@query("actor_threats", """
with d as (select user_id, date_trunc('day', ts) as day, count(*) as n, sum((event_type='error')::int) as errors, sum((extract(hour from ts) < 6)::int) as night from events group by 1,2),
s as (select user_id, avg(n) as m, stddev_pop(n) as sd from d group by 1)
select user_id, day, n, case when sd > 0 and (n - m)/sd > 3 then 'high' when night > 5 then 'medium' when errors / n > 0.5 then 'low' else 'none' end as threat from d join s using (user_id)""")
def actor_threats(t):
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), F.sum((F.hour("ts") < 6).cast("int")).alias("night"))
    # a distance of over three deviations in whole numbers: rounding would decide the days at exactly three
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    s = d.groupBy("user_id").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(whole("n") * whole("n")).alias("q"))
    above = whole("k") * whole("n") - whole("s")
    far = (above > 0) & (above * above > (whole("k") * F.col("q") - whole("s") * whole("s")) * 9)
    threat = F.when(far, "high").when(F.col("night") > 5, "medium").when(F.col("errors") / F.col("n") > 0.5, "low").otherwise("none")
    return d.join(s, "user_id").select("user_id", "day", "n", threat.alias("threat"))


@query("event_gaps", """
select event_type, count(gap) as n, round(avg(gap), 3) as mean_gap, round(max(gap), 3) as longest from (select event_type, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts, event_id)) / 1e6 as gap from events) group by 1""")
def event_gaps(t):
    return S.gaps(t.events, "event_type", "ts", "event_id").groupBy("event_type").agg(F.count("gap_s").alias("n"), F.round(F.avg("gap_s"), 3).alias("mean_gap"), F.round(F.max("gap_s"), 3).alias("longest"))


@query("request_rate_5m", """
with w as (select time_bucket(interval 5 minutes, ts) as start, count(*) as n, sum((event_type='error')::int) as errors, quantile_cont(value, 0.95) as p95 from events group by 1)
select start, round(n / 300, 6) as rate, round(errors / n, 6) as error_rate, round(1 - errors / n, 6) as availability, round(p95, 6) as p95 from w""")
def request_rate_5m(t):
    w = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), F.percentile("value", 0.95).alias("p95"))
    n, e = F.col("n"), F.col("errors")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.round(n / 300, 6).alias("rate"), F.round(e / n, 6).alias("error_rate"), F.round(1 - e / n, 6).alias("availability"), F.round("p95", 6).alias("p95"))
