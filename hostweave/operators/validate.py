"""Checks of a synthetic corpus: novelty, hard constraints, fidelity, leaks. They report and never raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.operators.graph import off_graph
from hostweave.operators.profile import breadth_and_creds, inter_event_dt

PAIR = ["src_computer", "dst_computer"]


def edge_sets(rows: DataFrame) -> DataFrame:
    return rows.select("campaign_id", *PAIR).distinct()


def max_jaccard(synth: DataFrame, fit: DataFrame) -> DataFrame:
    """(campaign_id, max_jaccard): each synthetic campaign's largest similarity of edge sets to a fit campaign.

    Only campaigns that share an edge are compared; without one it is 0.
    """
    s, f = edge_sets(synth), edge_sets(fit).withColumnRenamed("campaign_id", "fit_id")
    sizes_s = s.groupBy("campaign_id").agg(F.count("*").alias("a"))
    sizes_f = f.groupBy("fit_id").agg(F.count("*").alias("b"))
    common = s.join(f, PAIR).groupBy("campaign_id", "fit_id").agg(F.count("*").alias("c"))
    scores = common.join(sizes_s, "campaign_id").join(sizes_f, "fit_id").groupBy("campaign_id").agg(F.max(F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("j"))
    return sizes_s.select("campaign_id").join(scores, "campaign_id", "left").select("campaign_id", F.coalesce("j", F.lit(0.0)).alias("max_jaccard"))


def novelty_summary(synth: DataFrame, fit: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: share of near duplicates (at or above the threshold), share of synthetic edges that fit lacks, and counts."""
    near = max_jaccard(synth, fit).agg(F.avg((F.col("max_jaccard") >= threshold).cast("double")).alias("pct_near_duplicate"), F.count("*").alias("n_campaigns"))
    s, f = synth.select(*PAIR).distinct(), fit.select(*PAIR).distinct()
    marked = s.join(f.withColumn("_in", F.lit(1)), PAIR, "left").agg(F.count("*").alias("n_synth_edges"), F.avg(F.col("_in").isNull().cast("double")).alias("edge_novelty_rate"))
    return near.join(F.broadcast(marked)).join(F.broadcast(f.agg(F.count("*").alias("n_fit_edges"))))


def jaccard_quantiles(synth: DataFrame, fit: DataFrame) -> DataFrame:
    j = max_jaccard(synth, fit)
    return j.agg(*[F.expr(f"percentile(max_jaccard, {x})").alias(n) for n, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.count_if(F.col("max_jaccard") == 0).alias("n_zero"))


def v1_checks(rows: DataFrame, edges: DataFrame, collection_seconds: int) -> DataFrame:
    """One row per check: (check, status, violations, extreme). Gaps are taken in emission order, never re-sorted by time."""
    gaps = rows.withColumn("dt", F.col("time") - F.lag("time").over(Window.partitionBy("campaign_id").orderBy("hop_index")))
    dt = gaps.agg(F.lit("timestamps_strictly_increasing").alias("check"), F.count_if(F.col("dt") <= 0).alias("violations"), F.min("dt").alias("extreme"))
    spans = rows.groupBy("campaign_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    window = spans.agg(F.lit("within_collection_window").alias("check"), F.count_if((F.col("lo") < 0) | (F.col("hi") > collection_seconds)).alias("violations"), F.max("hi").alias("extreme"))
    off = off_graph(rows, edges).agg(F.lit("edges_exist_in_graph").alias("check"), F.count("*").alias("violations"), F.lit(None).cast("long").alias("extreme"))
    out = dt.unionByName(window).unionByName(off).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))
    # all credentials are harvested at the foothold before any use, so there is nothing to check
    na = rows.sparkSession.sql("SELECT 'no_credential_used_before_acquisition' AS check, CAST(null AS bigint) AS violations, CAST(null AS bigint) AS extreme, 'n/a' AS status")
    return out.unionByName(na).select("check", "status", "violations", "extreme")


def all_pass(checks: DataFrame) -> DataFrame:
    return checks.agg((F.count_if(F.col("status") == "fail") == 0).alias("all_pass"))


def two_sided(synth: DataFrame, real: DataFrame, what: str, nodes: DataFrame | None = None) -> DataFrame:
    """(value, side): breadth, creds or dt per campaign, or the events' target in-degree; side 0 is synthetic."""

    def values(rows: DataFrame) -> DataFrame:
        if what == "dt":
            return inter_event_dt(rows).select(F.col("dt").alias("value"))
        if what == "in_degree":
            return rows.join(nodes.select(F.col("host").alias("dst_computer"), "in_degree"), "dst_computer", "left").select(F.coalesce("in_degree", F.lit(0)).alias("value"))
        return breadth_and_creds(rows).select(F.col(what).alias("value"))

    return values(synth).withColumn("side", F.lit(0)).unionByName(values(real).withColumn("side", F.lit(1)))


def unseen_edge_rate(rows: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Per class: rows, rows whose edge is unseen, and the share."""
    seen = edges.select(*PAIR).withColumn("_seen", F.lit(1))
    unseen = F.col("_seen").isNull()
    return rows.join(seen, PAIR, "left").groupBy(by).agg(F.count("*").alias("n"), F.count_if(unseen).alias("n_unseen"), F.avg(unseen.cast("double")).alias("rate"))


def benign_at_rarity(scored: DataFrame, percentile: float = 0.05) -> DataFrame:
    """One row: the percentile of the positives' edge_rarity, and the negatives at or above it."""
    bar = scored.where("label = 1").agg(F.expr(f"percentile(edge_rarity, {percentile})").alias("threshold"))
    at = F.col("edge_rarity") >= F.col("threshold")
    return scored.where("label = 0").join(F.broadcast(bar)).agg(F.first("threshold").alias("threshold"), F.count_if(at).alias("n_at"), F.avg(at.cast("double")).alias("share"))


def provenance(edges: DataFrame, auth_in_window: DataFrame) -> DataFrame:
    """One row: the edges' total weight, the window's events, and whether they agree."""
    return edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).join(F.broadcast(auth_in_window.agg(F.count("*").alias("events")))).withColumn("ok", F.col("weight") == F.col("events"))
