"""Detector and distribution metrics as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that running totals are computed over in parallel.
RANGES = 64


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds cum_<c> for each c, over distinct values of `order` in its order, without a single-task window.

    Values are cut into ranges at approximate quantiles; totals of the ranges before come from a table of RANGES rows.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005)))
    part = sum((F.when(F.col(order) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    ranged = df.withColumn("_part", -part if descending else part)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums])


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: tp, n and their totals over scores at least as high."""
    groups = scored.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count("*").alias("n"))
    return running_totals(groups, "score", ["tp", "n"], descending=True)


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: step-wise average precision; equal scores are one threshold. Null without positives."""
    steps = _by_score(scored, score, label)
    return steps.agg((F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")) / F.sum("tp")).alias("average_precision"), F.sum("tp").alias("positives"), F.sum("n").alias("rows"))


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, precision, recall) per distinct score, and a last point (null, 1, 0)."""
    steps = _by_score(scored, score, label)
    total = F.broadcast(steps.agg(F.sum("tp").alias("positives")))
    points = steps.join(total).select(F.col("score").alias("threshold"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"), (F.col("cum_tp") / F.col("positives")).alias("recall"))
    return points.unionByName(scored.sparkSession.sql("SELECT CAST(null AS double) AS threshold, 1D AS precision, 0D AS recall"))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    per = counts.join(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(per), label)


def mean_ci(cells: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and 1.96 standard errors (0 with fewer than two cells)."""
    n = F.count(value)
    return cells.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n >= 2, 1.96 * F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(0.0)).alias("ci"))


def paired_test(cells: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """t of the per-seed lift b - a with its mean, deviation and wins; t is null with fewer than two pairs."""
    d = cells.withColumn("_d", F.col(b) - F.col(a))
    n, mean, sd = F.count("_d"), F.avg("_d"), F.stddev_samp("_d")
    return d.groupBy(*by).agg(n.alias("n"), mean.alias("mean_lift"), sd.alias("sd_lift"), F.sum((F.col("_d") > 0).cast("long")).alias("wins"), F.when((n >= 2) & (sd > 0), mean / (sd / F.sqrt(n))).alias("t"))


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d, f = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            f *= c * d
    return 1 - front * f / a if swap else front * f / a


def ks_statistic(values: DataFrame, value: str = "value", side: str = "side") -> DataFrame:
    """One row: the largest distance of the two sides' distribution functions, over distinct values. side is 0 or 1."""
    first = F.col(side) == 0
    per = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    steps = running_totals(per, "v", ["a", "b"])
    n = F.broadcast(per.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    return steps.join(n).agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("ks"), F.first("na").alias("n_a"), F.first("nb").alias("n_b"))


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p."""
    en = math.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin from 0, with the last one closed."""
    return F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long")


def js_divergence(values: DataFrame, bins: int = 20, value: str = "value", side: str = "side") -> DataFrame:
    """One row: Jensen-Shannon divergence in bits of log10(1 + x) over equal bins of the pooled range."""
    logs = values.select(F.log10(1 + F.col(value).cast("double")).alias("v"), F.col(side).alias("s"))
    span = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    binned = logs.join(F.broadcast(span)).withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy("bin").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") != 0).alias("b"))
    shares = counts.join(F.broadcast(counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return shares.agg((F.sum(term(F.col("p")) + term(F.col("q"))) / 2).alias("js"))


def overlay_histogram(values: DataFrame, bins: int = 25, log: bool = False, value: str = "value", side: str = "side") -> DataFrame:
    """(side, bin, density) over equal bins of the pooled range, or geometric ones; what a chart would show."""
    x = F.col(value).cast("double")
    v = F.ln(F.greatest(x, F.lit(1.0))) if log else x
    span = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    binned = values.join(F.broadcast(span)).withColumn("bin", bin_of(v, F.col("lo"), F.col("hi"), bins))
    edge = lambda k: F.exp(F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins)
    # equal widths aren't taken from edges, whose last bits differ from bin to bin and turn ties of a later rounding
    area = F.col("total") * (edge(F.col("bin") + 1) - edge(F.col("bin"))) if log else F.col("total") * (F.col("hi") - F.col("lo")) / bins
    counts = binned.groupBy(side, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    totals = F.broadcast(counts.groupBy(side).agg(F.sum("n").alias("total")))
    return counts.join(totals, side).select(side, "bin", "n", (F.col("n") / area).alias("density"))
