"""Streaming queries over events, run to the end of the table and held against their batch equivalents."""

import uuid

from pyspark.sql import functions as F

from lumenquarry.operators.graph import checkpoint_folder
from lumenquarry.plans.base import query
from lumenquarry.streaming import events as S


def _run(t, make, mode):
    spark, d = t._spark, t._dir
    checkpoint_folder(spark)
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    stream = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return S.collected(make(stream.withColumn("ts", F.col("ts").cast("timestamp"))), name, mode, folder)


def _named(df):
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return df.select(ntz("start"), ntz("end"), "event_type", "n", F.round("total", 4).alias("total"), F.round("top", 6).alias("top"))


@query("stream_tumbling", """
select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total, round(max(value), 6) as top from events group by 1, 2, 3""")
def stream_tumbling(t):
    return _named(_run(t, lambda e: S.tumbling(e, "1 hour", "60 days", "event_type", "value"), "complete"))


@query("stream_sliding", """
with w as (select time_bucket(interval 1 hour, ts) - k * interval 1 hour as start, event_type, value from events, range(2) r(k))
select start, start + interval 2 hours as "end", event_type, count(*) as n, round(sum(value), 4) as total, round(max(value), 6) as top from w group by 1, 2, 3""")
def stream_sliding(t):
    return _named(_run(t, lambda e: S.sliding(e, "2 hours", "1 hour", "60 days", "event_type", "value"), "complete"))


@query("stream_profiles", "select user_id, count(*) as events, round(sum(value), 3) as total, case when sum(value) > 1000 then 'high' else 'none' end as threat from events group by 1")
def stream_profiles(t):
    df = _run(t, lambda e: S.actor_profiles(e, 1000.0), "update")
    last = df.groupBy("user_id").agg(F.max_by(F.struct("events", "total", "threat"), "events").alias("x"))
    return last.select("user_id", "x.events", F.round("x.total", 3).alias("total"), "x.threat")


@query("stream_dedup", "select count(distinct event_id) as n from events")
def stream_dedup(t):
    return _run(t, lambda e: S.deduplicated(e, "event_id", "60 days").select("event_id"), "append").agg(F.count("*").alias("n"))


@query("stream_sessions", """
with o as (select *, lag(ts) over (partition by user_id order by ts) as before from events), s as (select *, sum(case when before is null or ts > before + interval 6 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select min(ts) as start, max(ts) + interval 6 hours as "end", user_id, count(*) as n, round(sum(value), 4) as total, round(max(value), 6) as top from s group by user_id, k""")
def stream_sessions(t):
    df = _run(t, lambda e: S.sessions(e, "6 hours", "60 days", "user_id", "value"), "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return df.select(ntz("start"), ntz("end"), "user_id", "n", F.round("total", 4).alias("total"), F.round("top", 6).alias("top"))
