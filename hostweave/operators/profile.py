"""Distributions of the fit campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breadth_and_creds(rows: DataFrame) -> DataFrame:
    """Per campaign: breadth (distinct targets) and creds (distinct source users), with idx for bootstrap draws."""
    per = rows.groupBy("campaign_id").agg(F.countDistinct("dst_computer").alias("breadth"), F.countDistinct("src_user").alias("creds"))
    return per.withColumn("idx", F.row_number().over(Window.orderBy("campaign_id")) - 1)


def inter_event_dt(rows: DataFrame) -> DataFrame:
    """Positive gaps within campaigns, with idx by campaign and time; one row with dt 1 where there are none."""
    order = Window.partitionBy("campaign_id").orderBy("time")
    gaps = rows.select("campaign_id", "time", (F.col("time") - F.lag("time").over(order)).alias("dt")).where("dt > 0")
    none = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("campaign_id"), F.lit(0).cast("long").alias("time"), F.lit(1).cast("long").alias("dt"))
    some = gaps.agg(F.count("*").alias("n"))
    gaps = gaps.unionByName(none.join(F.broadcast(some)).where("n = 0").drop("n"))
    return gaps.select("dt", (F.row_number().over(Window.orderBy("campaign_id", "time", "dt")) - 1).alias("idx"))


def campaign_table(rows: DataFrame) -> DataFrame:
    """Per campaign: events, targets, sources, credentials, start, end, duration."""
    return rows.groupBy("campaign_id").agg(
        F.count("*").alias("events"), F.countDistinct("dst_computer").alias("targets"), F.countDistinct("src_computer").alias("sources"), F.countDistinct("src_user").alias("creds"), F.min("time").alias("t_min"), F.max("time").alias("t_max"), (F.max("time") - F.min("time")).alias("duration")
    )


def hop_bucket(hop: str = "hop_index") -> Column:
    return F.when(F.col(hop) == 0, "0").when(F.col(hop) <= 2, "1-2").otherwise("3+")


def seed_hosts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees of the first event's source in each campaign, where the graph has it."""
    return rows.where("hop_index = 0").join(nodes, F.col("src_computer") == F.col("host")).select("campaign_id", "host", "in_degree", "out_degree")


def target_indegree(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes, F.col("dst_computer") == F.col("host")).select("campaign_id", "hop_index", "host", "in_degree")


def conditional_attributes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of auth_type|logon_type|success by is_server|hop bucket|orientation; a target that the graph lacks is no server."""
    joined = rows.join(nodes.select("host", "is_server"), F.col("dst_computer") == F.col("host"), "left")
    server = F.when(F.coalesce("is_server", F.lit(False)), "True").otherwise("False")
    return joined.groupBy(F.concat_ws("|", server, hop_bucket(), "auth_orientation").alias("condition"), F.concat_ws("|", "auth_type", "logon_type", "success").alias("value")).agg(F.count("*").alias("cnt"))


def credential_reuse(rows: DataFrame) -> DataFrame:
    """Per campaign and user, the position of first use."""
    return rows.groupBy("campaign_id", F.col("src_user").alias("user")).agg(F.min("hop_index").alias("first_hop"))


def indegree_quantiles(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Quartiles of the events' target in-degree, 0 for a target that the graph lacks."""
    d = rows.join(nodes.select("host", "in_degree"), F.col("dst_computer") == F.col("host"), "left").select(F.coalesce("in_degree", F.lit(0)).cast("double").alias("d"))
    return d.agg(*[F.expr(f"percentile(d, {x})").alias(n) for n, x in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])


def attribute_share(rows: DataFrame, by: str) -> DataFrame:
    """Shares of NTLM, of events of a host with itself, of machine accounts and of unchanged users, by class."""
    share = lambda c, n: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n)
    return rows.groupBy(by).agg(share(F.col("auth_type") == "NTLM", "ntlm"), share(F.col("src_computer") == F.col("dst_computer"), "self_auth"), share(F.col("src_user").like("%$@%"), "machine"), share(F.col("src_user") == F.col("dst_user"), "same_user"))
