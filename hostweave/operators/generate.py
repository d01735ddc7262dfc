"""Synthetic fan-out campaigns along observed edges. Every attempt is a row; nothing depends on the order of execution."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.hashrng import race, u
from hostweave.operators.sampling import bootstrap, weighted_draws
from hostweave.schema import DAY, HOUR, MALICIOUS
from hostweave.sources.shared import cut

#: Attempts per campaign asked for, at most.
MAX_ATTEMPTS = 10


def foothold_candidates(nodes: DataFrame, min_out_degree: int) -> DataFrame:
    return nodes.where(F.col("out_degree") >= min_out_degree).select("host", "out_degree")


def attempts(spark, n: int, since: int = 0) -> DataFrame:
    return spark.range(since, n).select(F.col("id").alias("attempt"))


def pick_footholds(tries: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """(attempt, foothold), by out-degree."""
    return weighted_draws(tries, candidates, "out_degree", "host", seed, "foothold", "attempt").select("attempt", F.col("host").alias("foothold"), "out_degree")


def harvest(footholds: DataFrame, user_host: DataFrame, max_creds: int, seed: int) -> DataFrame:
    """(attempt, user): users seen on the foothold, at most max_creds of them."""
    seen = footholds.select("attempt", "foothold").join(user_host.select(F.col("computer").alias("foothold"), "user").distinct(), "foothold")
    rank = F.row_number().over(Window.partitionBy("attempt").orderBy(u(seed, "harvest", "attempt", "user"), "user"))
    return seen.withColumn("_r", rank).where(F.col("_r") <= max_creds).select("attempt", "user")


def restrict(creds: DataFrame, per_campaign: DataFrame, seed: int) -> DataFrame:
    """Of the harvested users m, drawn from per_campaign (creds, idx); all where m isn't smaller than their number."""
    m = bootstrap(creds.select("attempt").distinct(), per_campaign.select("idx", F.col("creds").alias("m")), seed, "creds", "attempt")
    rank = F.row_number().over(Window.partitionBy("attempt").orderBy(u(seed, "restrict", "attempt", "user"), "user"))
    return creds.join(m, "attempt").withColumn("_r", rank).where((F.col("_r") <= F.col("m")) | (F.col("m") <= 0)).select("attempt", "user")


def generate(edges: DataFrame, nodes: DataFrame, user_host: DataFrame, breadth: DataFrame, dts: DataFrame, n: int, *, alpha: float = 1.0, beta: float = 1.0, credential_bonus: float = 2.0, min_out_degree: int = 25, max_creds: int = 30, seed: int = 0, naive: bool = False, tries: int | None = None) -> DataFrame:
    """(attempt, campaign_id, hop_index, dt_offset, user, src_computer, dst_computer, capped) of the first n valid attempts.

    edges, nodes, user_host: of the fit window. breadth: (idx, breadth, creds); dts: (idx, dt). An attempt draws a foothold
    by out-degree, harvests its users, keeps as many as a fit campaign has, draws as many distinct targets among the
    foothold's edges as a fit campaign has, by weight^alpha (in_degree + 1)^beta, times the bonus where a kept user is
    known, and gives each the user to use. Attempts whose foothold has no users are discarded. naive drops weights,
    restriction and the preference for known users. ValueError if no foothold qualifies; a warning where MAX_ATTEMPTS
    attempts a campaign give fewer than n.
    """
    spark = edges.sparkSession
    pool = foothold_candidates(nodes, min_out_degree)
    if pool.isEmpty():
        raise ValueError(f"no foothold has out-degree >= {min_out_degree}")
    if naive:
        alpha, beta, credential_bonus = 0.0, 0.0, 1.0
    most, done, found, footholds, used = tries or MAX_ATTEMPTS * n, 0, 0, None, None
    # an attempt's draws depend on its number alone, so waves of attempts give what all at once would
    while found < n and done < most:
        upto = min(most, n + n // 8 + 64 if not done else 3 * done)
        feet = cut(pick_footholds(attempts(spark, upto, done), pool, seed), "footholds")
        creds = cut(harvest(feet, user_host, max_creds, seed), "creds")
        kept = creds if naive else cut(restrict(creds, breadth, seed), "restricted")
        footholds, used = (feet, kept) if used is None else (footholds.unionByName(feet), used.unionByName(kept))
        found, done = used.select("attempt").distinct().count(), upto
    if found < n:
        warnings.warn(f"{found} of {n} campaigns: the other attempts of {done} have footholds without users", stacklevel=2)
    valid = used.select("attempt").distinct().withColumn("campaign_id", F.row_number().over(Window.orderBy("attempt")) - 1).where(F.col("campaign_id") < n)
    used = cut(used.join(valid, "attempt"), "used")
    valid = used.select("attempt", "campaign_id").distinct()
    sizes = bootstrap(footholds.join(valid, "attempt"), breadth.select("idx", "breadth"), seed, "breadth", "attempt")
    sizes = sizes.withColumn("capped", F.col("breadth") > F.col("out_degree")).withColumn("k", F.least("breadth", "out_degree"))

    known = used.join(user_host.select("user", F.col("computer").alias("dst_computer")).distinct(), "user").select("attempt", "dst_computer", "user")
    targets = sizes.join(edges.withColumnRenamed("src_computer", "foothold"), "foothold").join(nodes.select(F.col("host").alias("dst_computer"), "in_degree"), "dst_computer")
    bonus = known.select("attempt", "dst_computer").distinct().withColumn("known", F.lit(True))
    targets = targets.join(bonus, ["attempt", "dst_computer"], "left")
    weight = F.pow(F.col("weight").cast("double"), F.lit(alpha)) * F.pow(F.col("in_degree") + F.lit(1.0), F.lit(beta)) * F.when(F.col("known"), credential_bonus).otherwise(1.0)
    targets = targets.withColumn("w", weight).withColumn("_race", race(seed, "target", "w", "attempt", "dst_computer"))
    order = Window.partitionBy("attempt").orderBy("_race", "dst_computer")
    chosen = targets.withColumn("hop_index", F.row_number().over(order) - 1).where(F.col("hop_index") < F.col("k"))
    chosen = bootstrap(chosen, dts, seed, "dt", "attempt", "hop_index")
    offset = F.sum("dt").over(Window.partitionBy("attempt").orderBy("hop_index"))
    chosen = chosen.select("attempt", "campaign_id", "hop_index", offset.alias("dt_offset"), F.col("foothold").alias("src_computer"), "dst_computer", "capped")

    everyone = used.groupBy("attempt").agg(F.sort_array(F.collect_set("user")).alias("pool"))  # at most max_creds users each
    preferred = known.groupBy("attempt", "dst_computer").agg(F.sort_array(F.collect_set("user")).alias("best"))
    out = chosen.join(everyone, "attempt")
    if naive:
        out = out.withColumn("_pool", F.col("pool"))
    else:
        out = out.join(preferred, ["attempt", "dst_computer"], "left").withColumn("_pool", F.coalesce("best", "pool"))
    user = F.element_at("_pool", (F.floor(u(seed, "user", "attempt", "dst_computer") * F.size("_pool")) + 1).cast("int"))
    return out.select("attempt", "campaign_id", "hop_index", "dt_offset", user.alias("user"), "src_computer", "dst_computer", "capped")


def corpus_stats(campaigns: DataFrame) -> DataFrame:
    """One row: n, attempts (up to the last one used), discard_rate, cap_rate."""
    per = campaigns.groupBy("campaign_id").agg(F.first("attempt").alias("attempt"), F.first("capped").alias("capped"))
    n, tried = F.count("*"), F.max("attempt") + 1
    return per.agg(n.alias("n"), tried.alias("attempts"), ((tried - n) / tried).alias("discard_rate"), F.avg(F.col("capped").cast("double")).alias("cap_rate"))


def start_times(campaigns: DataFrame, hourly: DataFrame, collection_seconds: int, seed: int) -> DataFrame:
    """(campaign_id, start): day uniform, hour by volume, second uniform, among the starts that end in time.

    Drawing again until a start fits is a draw among those that fit: a campaign that leaves a day or more fits from any
    second of each of its days; one that leaves less begins on day 0, and an hour counts with the share of its seconds
    that are early enough. A campaign has no row only where no start fits; place() raises on it.
    """
    spans = campaigns.groupBy("campaign_id").agg(F.max("dt_offset").alias("longest"))
    hours = F.broadcast(hourly.where("cnt > 0").agg(F.sort_array(F.collect_list(F.struct("hour", "cnt"))).alias("hours")))  # 24 at most
    room = F.col("room")
    spans = spans.withColumn("room", F.lit(collection_seconds) - F.col("longest")).join(hours)
    seconds = lambda h: F.greatest(F.least(room - h["hour"] * HOUR + 1, F.lit(HOUR)), F.lit(0)).cast("long")
    zero = F.expr("CAST(array() AS array<struct<hour:bigint,seconds:bigint,hi:bigint>>)")

    def step(acc, h):
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["hi"]).otherwise(F.lit(0))
        return F.array_append(acc, F.struct(h["hour"].cast("long").alias("hour"), seconds(h).alias("seconds"), (before + h["cnt"] * seconds(h)).cast("long").alias("hi")))

    placed = spans.withColumn("steps", F.aggregate("hours", zero, step)).where(F.size("steps") > 0).withColumn("total", F.element_at("steps", -1)["hi"]).where("total > 0")
    r = u(seed, "hour", "campaign_id") * F.col("total").cast("double")
    placed = placed.withColumn("_r", r).withColumn("at", F.filter("steps", lambda s: s["hi"].cast("double") > F.col("_r"))[0])
    days = F.greatest(F.floor(room / DAY), F.lit(1))
    start = F.floor(u(seed, "day", "campaign_id") * days) * DAY + F.col("at.hour") * HOUR + F.floor(u(seed, "second", "campaign_id") * F.col("at.seconds"))
    return placed.select("campaign_id", start.cast("long").alias("start"))


def place(campaigns: DataFrame, starts: DataFrame) -> DataFrame:
    placed = campaigns.join(starts, "campaign_id", "left")
    if not placed.where("start IS NULL").isEmpty():
        raise ValueError("a campaign doesn't fit into the collection window")
    return placed.withColumn("time", F.col("start") + F.col("dt_offset"))


def as_rows(placed: DataFrame) -> DataFrame:
    """Log rows with constant attributes, and their labels; row_id is dense by campaign and hop."""
    sizes = placed.groupBy("campaign_id").agg(F.count("*").alias("_n"))
    before = sizes.select("campaign_id", (F.sum("_n").over(Window.orderBy("campaign_id")) - F.col("_n")).alias("_before"))
    out = placed.join(before, "campaign_id")
    constants = [F.lit(v).alias(k) for k, v in MALICIOUS.items()]
    return out.select("time", F.col("user").alias("src_user"), F.col("user").alias("dst_user"), "src_computer", "dst_computer", *constants, (F.col("_before") + F.col("hop_index")).alias("row_id"), F.lit(1).alias("is_malicious"), "campaign_id", "hop_index")
