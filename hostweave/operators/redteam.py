"""Labelled events: recovery from the log, campaigns, the frozen split, and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.schema import AUTH_COLS, EVENT_KEY, between

#: Redteam tables up to this number of events are broadcast to the log.
BROADCAST_EVENTS = 200_000


def few(df: DataFrame) -> DataFrame:
    """The table marked for broadcast where it has no more than BROADCAST_EVENTS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS else df


def event_keys(redteam: DataFrame) -> DataFrame:
    return redteam.select("time", F.col("user").alias("src_user"), "src_computer", "dst_computer").distinct()


def recover_redteam(auth: DataFrame, redteam: DataFrame) -> DataFrame:
    """The log's rows of labelled events, one for each (time, user, source, destination), in AUTH_COLS.

    The small table is broadcast into an inner join with the log. Of several log rows for one event the first by its
    other columns is taken.
    """
    hits = auth.join(few(event_keys(redteam)), EVENT_KEY)
    order = Window.partitionBy(*EVENT_KEY).orderBy("dst_user", "auth_type", "logon_type", "auth_orientation", "success")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*AUTH_COLS)


def unmatched(matched: DataFrame, redteam: DataFrame) -> DataFrame:
    """Labelled events without a row in the log."""
    return event_keys(redteam).join(matched.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def sessionize(rows: DataFrame, gap: int) -> DataFrame:
    """Adds campaign_id from 0: a gap of more than `gap` seconds starts a campaign.

    For labelled events, of which there are few: the window has one partition. sessions_of() is the form for streams.
    """
    order = Window.orderBy(*EVENT_KEY)
    new = F.coalesce((F.col("time") - F.lag("time").over(order) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("campaign_id", F.sum("_new").over(order)).drop("_new")


def hop_index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hop_index", F.row_number().over(Window.partitionBy("campaign_id").orderBy(*EVENT_KEY)) - 1)


def freeze_split(rows: DataFrame, fraction: float) -> DataFrame:
    """Adds side (fit or holdout), by campaigns in the order of their start.

    The cut lies in the gap between campaigns that is nearest to the given fraction of the timeline, which runs from the
    first start to the end of the campaign that starts last; the first of equally near gaps is taken. With less than two
    campaigns all rows are fit.
    """
    spans = rows.groupBy("campaign_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    order = Window.orderBy("lo", "campaign_id")
    last = F.max(F.struct("lo", "campaign_id", "hi")).over(Window.partitionBy())["hi"]
    first = F.min("lo").over(Window.partitionBy())
    gaps = spans.select("campaign_id", F.row_number().over(order).alias("k"), "hi", F.lead("lo").over(order).alias("next"), (first + F.lit(fraction) * (last - first)).alias("cut"))
    distance = F.greatest(F.col("hi") - F.col("cut"), F.col("cut") - F.col("next"), F.lit(0.0))
    best = gaps.where("next IS NOT NULL").agg(F.min(F.struct(distance.alias("d"), "k"))["k"].alias("best"))
    sides = gaps.join(F.broadcast(best)).select("campaign_id", F.when(F.col("best").isNull() | (F.col("k") <= F.col("best")), "fit").otherwise("holdout").alias("side"))
    return rows.join(sides, "campaign_id")


def hard_negatives(auth: DataFrame, redteam: DataFrame, edges: DataFrame, fit: tuple[int, int], holdout: tuple[int, int]) -> DataFrame:
    """Log rows on attacked edges and in either window that aren't labelled events, with side."""
    inside = between(auth, *fit) | between(auth, *holdout)
    rows = auth.where(inside).join(few(edges.select("src_computer", "dst_computer").distinct()), ["src_computer", "dst_computer"])
    rows = rows.join(few(event_keys(redteam)), EVENT_KEY, "left_anti")
    return rows.withColumn("side", F.when(F.col("time").between(*fit), "fit").otherwise("holdout")).select(*AUTH_COLS, "side")


def chained_links(rows: DataFrame) -> DataFrame:
    """Events whose source was the target of an earlier event of their campaign."""
    earlier = rows.groupBy("campaign_id", F.col("dst_computer").alias("src_computer")).agg(F.min("time").alias("reached"))
    return rows.join(earlier, ["campaign_id", "src_computer"]).where("reached < time").drop("reached")


def class_edge_overlap(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    pair = ["src_computer", "dst_computer"]
    return positives.select(*pair).intersect(negatives.select(*pair))
