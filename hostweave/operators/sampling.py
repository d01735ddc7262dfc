"""Samples, class mixes and draws by keyed randomness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.hashrng import first_k, race, u
from hostweave.operators.graph import without_edges
from hostweave.operators.metrics import running_totals
from hostweave.schema import AUTH_COLS, between

KEY = ("time", "src_user", "src_computer", "dst_computer", "event_id")


#: Draws up to this size are one distributed top-k, whose rows meet in one task.
TOP_ROWS = 100_000
#: Ranges of a running total over a pool that is drawn from with replacement, at most.
MOST_SLOTS = 1 << 20


def choice(df: DataFrame, n: int, seed: int, stream: str, *keys: str) -> DataFrame:
    """n rows uniformly without replacement; keys make rows distinct.

    Of a large draw, rows whose number is surely among the n smallest are taken as they are; only those in the narrow
    band about the n-th one are sorted, so no task holds the draw.
    """
    if n <= TOP_ROWS:
        return first_k(df, n, u(seed, stream, *keys), *keys)
    total = df.count()
    if n >= total:
        return df
    numbered = df.withColumn("_u", u(seed, stream, *keys))
    slack = 8 * math.sqrt(n) + 64
    low, high = max(0.0, (n - slack) / total), (n + slack) / total
    seen = numbered.agg(F.count_if(F.col("_u") < low).alias("sure"), F.count_if(F.col("_u") < high).alias("reach")).first()
    if not seen["sure"] <= n <= seen["reach"]:  # eight standard deviations away
        return first_k(df, n, u(seed, stream, *keys), *keys)
    band = first_k(numbered.where((F.col("_u") >= low) & (F.col("_u") < high)), n - seen["sure"], "_u", *keys)
    return numbered.where(F.col("_u") < low).unionByName(band).drop("_u")


def weighted_choice(df: DataFrame, n: int, weight: str, seed: int, stream: str, *keys: str) -> DataFrame:
    """n rows without replacement, by weight, with draw_rank in the order of the draw."""
    raced = df.withColumn("_race", race(seed, stream, weight, *keys))
    out = first_k(raced, n, "_race", *keys)
    return out.withColumn("draw_rank", F.row_number().over(Window.orderBy("_race", *keys)) - 1).drop("_race")


def weighted_draws(draws: DataFrame, pool: DataFrame, weight: str, order: str, seed: int, stream: str, *keys: str) -> DataFrame:
    """For each row of draws one row of pool, by weight, with replacement.

    The running weights are cut into as many equal slots as pool has rows; a draw meets only the ranges of its own slot,
    about two of them, in a join on the slot. pool has a row per host: its running weights are one sorted pass.
    """
    span = pool.agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("total")).first()
    slots, total = min(max(span["n"], 1), MOST_SLOTS), span["total"] or 0.0
    slot = lambda x: F.least(F.floor(x / F.lit(total) * slots), F.lit(slots - 1)).cast("long")
    ranges = pool.withColumn("_hi", F.sum(F.col(weight).cast("double")).over(Window.orderBy(order))).withColumn("_lo", F.col("_hi") - F.col(weight))
    ranges = ranges.where(F.col(weight) > 0).withColumn("_slot", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))))
    placed = draws.withColumn("_r", u(seed, stream, *keys) * F.lit(total)).withColumn("_slot", slot(F.col("_r")))
    return placed.join(ranges, "_slot").where((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi"))).drop("_r", "_lo", "_hi", "_slot")


def bootstrap(draws: DataFrame, values: DataFrame, seed: int, stream: str, *keys: str) -> DataFrame:
    """For each row of draws one row of values (dense idx from 0), with replacement."""
    n = values.agg(F.count("*").alias("_n"))
    placed = draws.join(F.broadcast(n)).withColumn("_i", F.floor(u(seed, stream, *keys) * F.col("_n")).cast("long")).drop("_n")
    return placed.join(values.withColumnRenamed("idx", "_i"), "_i").drop("_i")


def benign_sample(auth: DataFrame, t_lo: int, t_hi: int, n: int, redteam_edges: DataFrame, seed: int, sample_then_filter: bool = False) -> DataFrame:
    """n rows of the window (both ends inside), then without those on attacked edges.

    sample_then_filter draws from the whole log first, as some engines do when a sample clause stands by a filter; it
    yields the window's share of n.
    """
    inside = between(auth, t_lo, t_hi)
    keys = [k for k in KEY if k in auth.columns]
    drawn = choice(auth, n, seed, "benign", *keys).where(inside) if sample_then_filter else choice(auth.where(inside), n, seed, "benign", *keys)
    return without_edges(drawn, redteam_edges).select(*AUTH_COLS, *[k for k in keys if k not in AUTH_COLS])


def rebalanced_sizes(n_malicious: int, n_benign: int, rate: float) -> tuple[int, int]:
    """(malicious, benign) rows for malicious : benign = rate, shrinking whichever class is over; halves round to even."""
    if rate * n_benign <= n_malicious:
        return round(rate * n_benign), n_benign
    return n_malicious, min(n_benign, round(n_malicious / rate))


def mixed_corpus(malicious: DataFrame, benign: DataFrame, rate: float, seed: int, keys: tuple[str, ...] = KEY[:4]) -> DataFrame:
    """AUTH_COLS with is_malicious, row_id by time (malicious first among equal times), campaign_id and hop_index -1."""
    m, b = rebalanced_sizes(malicious.count(), benign.count(), rate)
    ranked = [(choice(df, n, seed, stream, *keys).withColumn("_u", u(seed, stream, *keys)), flag) for df, n, stream, flag in ((malicious, m, "mix-malicious", 1), (benign, b, "mix-benign", 0))]
    rows = [df.select(*AUTH_COLS, "_u", F.lit(flag).alias("is_malicious")) for df, flag in ranked]
    out = rows[0].unionByName(rows[1])
    return dense_ids(out, "time", [F.desc("is_malicious"), F.col("_u"), *[F.col(k) for k in keys]]).drop("_u").withColumns({"campaign_id": F.lit(-1).cast("long"), "hop_index": F.lit(-1).cast("long")})


def dense_ids(rows: DataFrame, coarse: str, then: list, name: str = "row_id") -> DataFrame:
    """Dense ids from 0 in the order of `coarse` (an integer column, such as a second) and `then`: the rows of smaller values, plus the place among those of the same value. A task sorts the rows of a few values, never a day or all."""
    counts = rows.groupBy(coarse).agg(F.count("*").alias("_n"))
    offsets = running_totals(counts, coarse, ["_n"]).select(coarse, (F.col("cum__n") - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(coarse).orderBy(*then)) - 1
    return rows.withColumn("_place", place).join(offsets, coarse).withColumn(name, F.col("_before") + F.col("_place")).drop("_before", "_place")


def downsample_eval(scored: DataFrame, rate: float | None, seed: int, key: str, label: str = "label") -> DataFrame:
    """All positives, and round(positives * (1 - rate) / rate) negatives; all rows for None; ValueError with too few negatives."""
    if rate is None:
        return scored
    n = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    want = round(n["p"] * (1 - rate) / rate)
    if want > n["n"]:
        raise ValueError(f"{want} negatives asked for, {n['n']} there")
    negatives = choice(scored.where(F.col(label) == 0), want, seed, "eval", key)
    return scored.where(F.col(label) == 1).unionByName(negatives.select(*scored.columns))


def draw_campaigns(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """k distinct campaign ids; ValueError if there are fewer."""
    pool = ids.select("campaign_id").distinct()
    if pool.count() < k:
        raise ValueError(f"{k} campaigns asked for, fewer there")
    return choice(pool, k, seed, "campaigns", "campaign_id")


def stack_classes(positives: list[DataFrame], negatives: DataFrame) -> DataFrame:
    """Union with label 1 and 0; ValueError unless all have the same columns in the same order."""
    if any(p.dtypes != negatives.dtypes for p in positives):
        raise ValueError("the classes' columns differ")
    out = negatives.withColumn("label", F.lit(0))
    for p in positives:
        out = out.unionByName(p.withColumn("label", F.lit(1)))
    return out
