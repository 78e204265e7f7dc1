"""Data quality, drift, fairness, calibration, uncertainty and effect estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquarry.operators.graph import cut
from lumenquarry.operators.ordering import running_sums


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: share of values that are neither null, NaN nor empty; over 5 % missing is an issue."""
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        bad = F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            bad = bad | F.isnan(c)
        if kinds[c] == "string":
            bad = bad | (F.col(c) == "")
        return F.sum(bad.cast("long"))

    wide = df.agg(F.count("*").alias("n"), *[missing(c).alias(c) for c in columns])
    long = wide.unpivot(["n"], columns, "feature", "missing")
    share = F.col("missing") / F.col("n")
    severity = F.when(share > 0.2, "high").when(share > 0.05, "medium").otherwise("none")
    return long.select("feature", F.round(1 - share, 6).alias("completeness"), severity.alias("severity"))


def fences(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """q1, q3 (linear interpolation) and the 1.5 IQR fences of a column, per group."""
    q = df.groupBy(*by).agg(F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})


def outliers(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per group: rows, rows outside the fences."""
    f = fences(df, column, [by])
    out = (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))
    return df.join(f, by).groupBy(by).agg(F.count("*").alias("n"), F.sum(out.cast("long")).alias("outliers"))


def ks_statistic(df: DataFrame, column: str, is_reference: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples in one frame: counts per value, then running sums over ranges of values."""
    per = df.groupBy(F.col(column).alias("x")).agg(F.sum(is_reference.cast("long")).alias("r"), F.sum((~is_reference).cast("long")).alias("c"))
    per = running_sums(per, ["x"], ["r", "c"])
    total = F.broadcast(per.agg(F.max("sum_r").alias("all_r"), F.max("sum_c").alias("all_c")))  # one row
    gap = F.abs(F.col("sum_r") / F.col("all_r") - F.col("sum_c") / F.col("all_c"))
    return per.join(total).agg(F.round(F.max(gap), 6).alias("ks"))


def chi_square(df: DataFrame, column: str, is_reference: Column) -> DataFrame:
    """Chi-square of the current counts against the reference's shares, aligned by category."""
    per = df.groupBy(F.col(column).alias("x")).agg(F.sum(is_reference.cast("long")).alias("r"), F.sum((~is_reference).cast("long")).alias("c"))
    per = cut(per)
    total = F.broadcast(per.agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c")))  # one row
    expected = F.col("r") * F.col("all_c") / F.col("all_r")
    part = F.when(expected > 0, (F.col("c") - expected) * (F.col("c") - expected) / expected)
    return per.join(total).select(part.alias("p")).agg(F.round(F.sum("p"), 4).alias("chi2"), F.count("*").alias("categories"))


def group_rates(df: DataFrame, group: str, prediction: str, label: str) -> DataFrame:
    """Per group: rows, positive rate, true positive rate, false positive rate (null without such labels)."""
    hit = F.col(prediction).cast("double")
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(hit).alias("rate"),
        F.avg(F.when(F.col(label) == 1, hit)).alias("tpr"), F.avg(F.when(F.col(label) == 0, hit)).alias("fpr"),
    )


def fairness(df: DataFrame, group: str, prediction: str, label: str) -> DataFrame:
    """One row: demographic parity, equalized odds, equal opportunity (1 minus spreads), and the severity of the worst."""
    rates = group_rates(df, group, prediction, label)
    spread = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    s = rates.agg(spread("rate").alias("r"), spread("tpr").alias("t"), spread("fpr").alias("f"))
    parity, odds, opportunity = 1 - F.col("r"), 1 - (F.col("t") + F.col("f")) / 2, 1 - F.col("t")
    worst = F.least(parity, odds)
    level = F.when(worst < 0.5, "critical").when(worst < 0.8, "medium").otherwise("low")
    return s.select(F.round(parity, 6).alias("demographic_parity"), F.round(odds, 6).alias("equalized_odds"), F.round(opportunity, 6).alias("equal_opportunity"), level.alias("severity"))


def expected_calibration_error(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Sum over equal-width bins (low, high] of share times |mean confidence - accuracy|."""
    b = df.select(F.greatest(F.ceil(confidence * bins), F.lit(1)).alias("bin"), confidence.alias("conf"), correct.cast("double").alias("ok"))
    per = b.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("conf") - F.avg("ok")).alias("gap"))
    return per.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def conformal_width(df: DataFrame, truth: Column, predicted: Column, alpha: float = 0.1) -> DataFrame:
    """Half-width of a conformal interval: the absolute error's quantile at ceil((n + 1)(1 - alpha)) / n."""
    e = df.select(F.abs(truth - predicted).alias("e"))
    n = e.count()
    q = min(1.0, -(-(n + 1) * (1 - alpha) // 1) / n) if n else 1.0
    return e.agg(F.round(F.percentile("e", q), 6).alias("width"))


def noisy_or(p: Column) -> Column:
    """Aggregate 1 - prod(1 - p)."""
    return 1 - F.product(1 - p)


def ensemble(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Per key: mean, epistemic (population variance), aleatoric (half the deviation), total; few members: .5, 0, .5."""
    v, s = F.var_pop(value), 0.5 * F.stddev_pop(value)
    few = F.count("*") < least
    return df.groupBy(key).agg(
        F.round(F.avg(value), 6).alias("mean"), F.round(F.when(few, 0.5).otherwise(v), 4).alias("epistemic"),
        F.round(F.when(few, 0.0).otherwise(s), 4).alias("aleatoric"), F.round(F.when(few, 0.5).otherwise(F.sqrt(v * v + s * s)), 4).alias("total"),
    )


def paired_t(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, mean difference, t statistic and Cohen's d with its name, of paired columns."""
    p = df.select(a.alias("a"), b.alias("b"), (a - b).alias("d"))
    s = p.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    effect = F.abs(F.col("m") / F.sqrt((F.col("va") + F.col("vb")) / 2))
    name = F.when(effect < 0.2, "negligible").when(effect < 0.5, "small").when(effect < 0.8, "medium").otherwise("large")
    return s.select("n", F.round("m", 4).alias("mean_difference"), F.round(F.col("m") / (F.col("sd") / F.sqrt("n")), 4).alias("t"), F.round(effect, 4).alias("effect"), name.alias("interpretation"))


def signed_rank(df: DataFrame, d: Column) -> DataFrame:
    """Wilcoxon sums of ranks of positive and negative differences; zeros out, ties share their mean rank.

    Ranks come from counts per distinct absolute value, so the running sum is over distinct values only.
    """
    per = df.select(F.abs(d).alias("x"), F.signum(d).alias("s")).where("x <> 0").groupBy("x").agg(F.count("*").alias("n"), F.sum((F.col("s") > 0).cast("long")).alias("pos"))
    per = running_sums(per, ["x"], ["n"])
    rank = F.col("sum_n") - F.col("n") + (F.col("n") + 1) / 2
    per = per.select((rank * F.col("pos")).alias("wp"), (rank * (F.col("n") - F.col("pos"))).alias("wn"))
    return per.agg(F.round(F.sum("wp"), 2).alias("w_plus"), F.round(F.sum("wn"), 2).alias("w_minus"))


def ipw_ate(df: DataFrame, treated: Column, outcome: Column, propensity: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Self-normalised inverse-propensity estimate of the average treatment effect."""
    e = F.greatest(F.lit(low), F.least(F.lit(high), propensity))
    t = treated.cast("double")
    r = df.select((t / e).alias("w1"), ((1 - t) / (1 - e)).alias("w0"), outcome.alias("y"))
    return r.agg(F.round(F.sum(F.col("w1") * F.col("y")) / F.sum("w1") - F.sum(F.col("w0") * F.col("y")) / F.sum("w0"), 4).alias("ate"))


def aipw_ate(df: DataFrame, treated: Column, outcome: Column, propensity: Column, mu1: Column, mu0: Column) -> DataFrame:
    """Doubly robust estimate and its standard error."""
    e = F.greatest(F.lit(0.01), F.least(F.lit(0.99), propensity))
    t = treated.cast("double")
    psi = (t * (outcome - mu1) / e + mu1) - ((1 - t) * (outcome - mu0) / (1 - e) + mu0)
    return df.select(psi.alias("p")).agg(F.round(F.avg("p"), 4).alias("ate"), F.round(F.stddev_pop("p") / F.sqrt(F.count("*")), 4).alias("se"))


def nearest_matches(treated: DataFrame, controls: DataFrame, width: float, k: int = 1) -> DataFrame:
    """For each treated (id, p) the k nearest controls within `width`, with replacement: a range join on cells.

    Cells are as wide as the caliper, so a partner is in the same or a neighbouring cell. Ties: the smaller id.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    t = treated.select(F.col("id").alias("t_id"), F.col("p").alias("t_p")).withColumn("cell", F.explode(F.array(cell("t_p") - 1, cell("t_p"), cell("t_p") + 1)))
    c = controls.select(F.col("id").alias("c_id"), F.col("p").alias("c_p"), cell("p").alias("cell"))
    gap = F.abs(F.col("t_p") - F.col("c_p"))
    near = t.join(c, "cell").withColumn("gap", gap).where(F.col("gap") <= width)
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy("gap", "c_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("t_id", "c_id", "gap", "rank")


def seeded_bootstrap(df: DataFrame, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """Mean of each Poisson(1) bootstrap draw: a row's multiplicity comes from a hash of (seed, draw, key), so reruns agree."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    steps, total, p = [], 0.0, 2.718281828459045**-1
    for m in range(1, 8):
        total += p
        steps.append((u >= total).cast("int"))
        p /= m
    times = reduce(Column.__add__, steps)
    rows = df.select(key, value).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times)
    return rows.groupBy("draw").agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))
