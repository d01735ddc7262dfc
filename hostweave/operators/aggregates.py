"""Counts over the authentication log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.schema import DAY, HOUR, FitWindow, bounded


def edge_counts(auth: DataFrame, window) -> DataFrame:
    """(src_computer, dst_computer, weight): events per directed pair of hosts; a host's events with itself count."""
    return bounded(auth, window).groupBy("src_computer", "dst_computer").agg(F.count("*").alias("weight"))


def edge_counts_arms(auth: DataFrame, fit: FitWindow) -> DataFrame:
    """Both arms from one scan: weight_full, and weight_fit (0 for pairs that the window hasn't seen; leave those out of the fit arm)."""
    inside = F.col("time") <= fit.t_hi
    return auth.groupBy("src_computer", "dst_computer").agg(F.count("*").alias("weight_full"), F.count_if(inside).alias("weight_fit"))


def user_host_counts(auth: DataFrame, window) -> DataFrame:
    """(user, computer, cnt): a source user is seen on the source and on the destination; an event of a host with itself counts twice.

    Each side is aggregated before the union, so the exchange carries pairs and not events.
    """
    rows = bounded(auth, window)
    sides = [rows.groupBy(F.col("src_user").alias("user"), F.col(c).alias("computer")).agg(F.count("*").alias("cnt")) for c in ("src_computer", "dst_computer")]
    return sides[0].unionByName(sides[1]).groupBy("user", "computer").agg(F.sum("cnt").alias("cnt"))


def hourly_volume(auth: DataFrame, window) -> DataFrame:
    """(hour, cnt): events by hour of day."""
    return bounded(auth, window).groupBy(F.expr(f"(time div {HOUR}) % 24").alias("hour")).agg(F.count("*").alias("cnt"))


def marginals(auth: DataFrame, window) -> DataFrame:
    """(column, value, cnt) of the four categorical columns from one joint count; a null is a value."""
    names = ["auth_type", "logon_type", "auth_orientation", "success"]
    joint = bounded(auth, window).groupBy(*names).agg(F.count("*").alias("n"))
    stacked = joint.select(F.expr("stack(4, " + ", ".join(f"'{c}', {c}" for c in names) + ") AS (column, value)"), "n")
    return stacked.groupBy("column", "value").agg(F.sum("n").alias("cnt"))


def total_weight(edges: DataFrame) -> DataFrame:
    """One row: the sum of weights as a double, 1 where there are no edges or all weigh nothing."""
    total = F.sum("weight").cast("double")
    return edges.agg(F.when(total > 0, total).otherwise(F.lit(1.0)).alias("total_weight"))


def cred_host_counts(user_host: DataFrame) -> DataFrame:
    return user_host.groupBy("user").agg(F.countDistinct("computer").alias("n_hosts"))


def host_users(user_host: DataFrame) -> DataFrame:
    """(computer, users): the sorted set of users seen on a host."""
    return user_host.groupBy("computer").agg(F.sort_array(F.collect_set("user")).alias("users"))


def business_hours_share(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Share of rows with an hour of day from 6 to 17."""
    flag = F.avg(F.when(F.expr(f"(time div {HOUR}) % 24").between(6, 17), 1.0).otherwise(0.0)).alias("share")
    return rows.groupBy(by).agg(flag) if by else rows.agg(flag)


def hour_share(rows: DataFrame) -> DataFrame:
    """(hour 0..23, share), with 0 for hours without rows."""
    hours = rows.sparkSession.range(24).select(F.col("id").alias("hour"))
    counted = rows.groupBy(F.expr(f"(time div {HOUR}) % 24").alias("hour")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return hours.join(counted, "hour", "left").join(F.broadcast(total)).select("hour", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"))


def events_per_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.expr(f"time div {DAY}").alias("day")).agg(F.count("*").alias("cnt"))
