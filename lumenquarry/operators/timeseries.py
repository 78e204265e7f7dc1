"""Rolling statistics, anomalies, trends, limits over event series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators.ordering import blocks_of_series, places, running_sums


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without zone, with the fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def history(by: str, order: list[str], size: int):
    """The `size` rows before the current one, of rows in blocks_of_series()."""
    return Window.partitionBy(by, "__block").orderBy(*order).rowsBetween(-size, -1)


def _own(rows: DataFrame) -> DataFrame:
    return rows.where("not __copy").drop("__block", "__copy")


def rolling(df: DataFrame, by: str, order: list[str], value: str, size: int) -> DataFrame:
    """Adds mean, population deviation, min, max and count over the last `size` rows, the current one included.

    A key's series is dealt into blocks that repeat the last rows of the block before, so a hot key is many tasks.
    """
    w = Window.partitionBy(by, "__block").orderBy(*order).rowsBetween(1 - size, 0)
    return _own(blocks_of_series(df, by, order, size - 1).withColumns({
        "r_mean": F.avg(value).over(w), "r_std": F.stddev_pop(value).over(w), "r_min": F.min(value).over(w),
        "r_max": F.max(value).over(w), "r_count": F.count(value).over(w),
    }))


def last_window(df: DataFrame, by: str, order: list[str], value: str, size: int) -> DataFrame:
    """Per key, statistics of its last `size` rows with interpolated percentiles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    last = df.withColumn("__r", rank).where(F.col("__r") <= size)
    p = lambda q: F.round(F.percentile(value, q), 6)
    return last.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"),
        p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def zscore_alerts(df: DataFrame, by: str, order: list[str], value: str, size: int = 100, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """Rows whose distance from their history's mean exceeds `threshold` deviations, with z and severity."""
    h = history(by, order, size)
    x = blocks_of_series(df, by, order, size)
    x = x.withColumns({"__n": F.count(value).over(h), "__m": F.avg(value).over(h), "__s": F.stddev_pop(value).over(h)})
    x = x.withColumn("z", F.when((F.col("__n") >= least) & (F.col("__s") > 1e-9), F.abs((F.col(value) - F.col("__m")) / F.col("__s"))))
    level = F.when(F.col("z") > 5, "critical").when(F.col("z") > 4, "high").when(F.col("z") > 3.5, "medium").otherwise("low")
    return _own(x).where(F.col("z") > threshold).withColumn("severity", level).drop("__n", "__m", "__s")


def iqr_alerts(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows outside their key's 1.5 IQR fences; severity by the distance in IQR; MAD z-score beside it."""
    q = df.groupBy(by).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"), F.percentile(value, 0.5).alias("med"))
    x = df.join(q, by)
    mad = x.groupBy(by).agg(F.percentile(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"))
    x = x.join(mad, by)
    iqr = F.col("q3") - F.col("q1")
    beyond = F.greatest(F.col("q1") - F.col(value), F.col(value) - F.col("q3")) / iqr
    x = x.withColumns({"beyond": beyond, "mad_z": F.abs(F.col(value) - F.col("med")) / (F.col("mad") * 1.4826)})
    level = F.when(F.col("beyond") > 3, "critical").when(F.col("beyond") > 2, "high").otherwise("medium")
    return x.where((iqr > 0) & (F.col("beyond") > 1.5)).withColumn("severity", level)


def degradation(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Per key: mean of the first and of the second half, relative rise and its severity."""
    x = places(df, by, order, "__r")
    x = x.join(df.groupBy(by).agg(F.count("*").alias("__n")), by)
    first = F.col("__r") <= F.floor(F.col("__n") / 2)
    g = x.groupBy(by).agg(F.avg(F.when(first, F.col(value))).alias("a"), F.avg(F.when(~first, F.col(value))).alias("b"))
    rise = (F.col("b") - F.col("a")) / F.col("a")
    level = F.when(rise > 0.3, "critical").when(rise > 0.2, "high").when(rise > 0.15, "medium").otherwise("none")
    return g.select(by, F.round("a", 6).alias("first_half"), F.round("b", 6).alias("second_half"), F.round(rise, 6).alias("rise"), level.alias("severity"))


def trend(df: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Least-squares slope per second and rate of change of last against first, in percent a second."""
    s = seconds(F.col(ts))
    g = df.withColumn("__s", s).groupBy(by).agg(
        F.regr_slope(value, F.col("__s") - 1.7e9).alias("slope"), F.min_by(value, F.struct("__s", value)).alias("v0"), F.max_by(value, F.struct("__s", value)).alias("v1"),
        F.min("__s").alias("s0"), F.max("__s").alias("s1"),
    )
    rate = F.when((F.col("v0") != 0) & (F.col("s1") > F.col("s0")), 100 * (F.col("v1") - F.col("v0")) / F.col("v0") / (F.col("s1") - F.col("s0")))
    return g.select(by, F.round(F.col("slope") * 1e6, 4).alias("slope_per_million_s"), F.round(rate * 1e6, 4).alias("rate_per_million_s"))


def sliding_count(df: DataFrame, by: str, ts: str, window_s: int) -> DataFrame:
    """Adds the number of the key's events in the window_s seconds up to and with the row's time."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = window_s * 1_000_000
    # spans of eight windows, with copies of the last window before: a hot key is a task for each span
    rows = df.withColumn("__us", micros).withColumn("__span", F.floor(F.col("__us") / (8 * width)))
    copied = F.col("__us") >= (F.col("__span") + 1) * (8 * width) - width
    spans = F.when(copied, F.array(F.col("__span"), F.col("__span") + 1)).otherwise(F.array("__span"))
    rows = rows.withColumn("__in", F.explode(spans))
    w = Window.partitionBy(by, "__in").orderBy("__us").rangeBetween(-width, 0)
    return rows.withColumn("in_window", F.count("*").over(w)).where("__in = __span").drop("__us", "__span", "__in")


def gaps(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """Adds the seconds since the key's previous event."""
    w = Window.partitionBy(by, "__block").orderBy(ts, tie)
    rows = blocks_of_series(df, by, [ts, tie], 1)
    return _own(rows.withColumn("gap_s", seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w)))


def islands(df: DataFrame, by: str, ts: str, tie: str, gap_s: int) -> DataFrame:
    """Sessions: runs of a key's events whose gaps are at most gap_s; one row each."""
    x = gaps(df, by, ts, tie).withColumn("__new", (F.coalesce("gap_s", F.lit(0)) > gap_s).cast("long"))
    x = running_sums(x, [by, ts, tie], ["__new"])
    first = x.groupBy(by).agg(F.min("sum___new").alias("__first"))
    x = x.join(first, by).withColumn("island", F.col("sum___new") - F.col("__first"))
    return x.groupBy(by, "island").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
