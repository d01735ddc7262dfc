"""Mixing sources to target weights (9, native): pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm.common import Workspace, unit
from hostweave.llm.located import let

WORD = r"[^\x20\x09-\x0D]+"
#: Units that one fold handles; also the fan-in of the reduction tree.
BLOCK = 64
#: Sources up to this number are broadcast to their documents; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000
EPSILON = 1e-9


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Per source: rank, source_size, units, target.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes. A target stops at
    `ceiling` times its source's size and the excess is reshared by weight: with sources in the order of cap per weight,
    the first k are capped and the level of the rest is what remains per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("units"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # levels only rise while sources are capped, so the first open source's level holds for all open ones
    first_open = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("fill"), "rank", "level"))).over(everything)
    return found.withColumn("at", first_open["level"]).select("source", "rank", "source_size", "units", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def _pair(acc: Column, b: Column, seed: int) -> Column:
    """Moves words between the carried unit and b until one probability is 0 or 1; the sum of p * s stays.

    The direction is random with the odds that keep each unit's expected probability.
    """
    a = acc["carry"]
    up = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])
    down = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
    draw = unit(F.lit(seed), a["id"], a["s"], b["id"], b["s"])
    moved = let(F.struct(up.alias("up"), down.alias("down"), draw.alias("r")), lambda m: F.when(m["r"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
    probabilities = let(moved, lambda m: F.struct((a["p"] + m / a["s"]).alias("a"), (b["p"] - m / b["s"]).alias("b")))

    def settle(q: Column) -> Column:
        a_done = (q["a"] <= EPSILON) | (q["a"] >= 1 - EPSILON)
        done = F.struct(F.when(a_done, a["id"]).otherwise(b["id"]).alias("id"), F.when(a_done, a["s"]).otherwise(b["s"]).alias("s"), F.when(a_done, q["a"]).otherwise(q["b"]).alias("p"))
        carry = F.struct(F.when(a_done, b["id"]).otherwise(a["id"]).alias("id"), F.when(a_done, b["s"]).otherwise(a["s"]).alias("s"), F.when(a_done, q["b"]).otherwise(q["a"]).alias("p"))
        return F.struct(F.array_append(acc["done"], done).alias("done"), carry.alias("carry"))

    return let(probabilities, settle)


def pivotal_round(units: DataFrame, most_units: int, seed: int, ws: Workspace) -> DataFrame:
    """units: rank, id, s (mass > 0), p in (0, 1), n (units of the rank). Returns rank, id, s, x (0 or 1).

    Level by level each block of about BLOCK units is folded into settled units and one residual; the residuals are
    the next level's units, until a rank has one block, whose last residual goes to the nearest integer.
    """
    levels = max(1, math.ceil(math.log(max(2, most_units), BLOCK)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    level = units.select("rank", "n", F.pmod(F.xxhash64(F.lit(seed), "id", "s"), blocks).alias("block"), F.struct("id", "s", "p").alias("u"))
    settled = []
    for k in range(levels + 1):
        # descending mass: large units meet each other first and small ones absorb the residual
        listed = level.groupBy("rank", "n", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("u.s")).alias("o"), F.xxhash64(F.lit(seed + k), "u.id").alias("h"), F.col("u").alias("u")))).alias("us"))
        listed = listed.withColumn("us", F.transform("us", lambda x: x["u"]))
        zero = F.struct(F.filter(F.slice("us", 1, 1), lambda x: F.lit(False)).alias("done"), F.element_at("us", 1).alias("carry"))
        folded = F.aggregate(F.slice("us", 2, F.greatest(F.size("us") - 1, F.lit(0))), zero, lambda acc, b: _pair(acc, b, seed + 1000 * (k + 1)))
        table = ws.put(listed.select("rank", "n", "block", folded.alias("f")), f"level{k}")
        settled.append(table.select("rank", F.explode("f.done").alias("u")))
        if k == levels:
            settled.append(table.select("rank", F.col("f.carry").alias("u")))
        else:
            level = table.select("rank", "n", F.floor(F.col("block") / BLOCK).cast("long").alias("block"), F.col("f.carry").alias("u"))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("rank", "u.id", "u.s", (F.col("u.p") >= 0.5).cast("long").alias("x"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    size counts the words `[^\\x20\\x09-\\x0D]+` of the whole text (a null text has 0). Every document of a source has
    target / source_size copies on average: the whole part is fixed and the fraction is rounded by pairing units and
    moving words between them, so a source's taken words differ from its target by at most half of one unit's words.
    Units are distinct (doc_id, size) pairs of a source; rows that repeat one get the same copies and weigh together.
    Documents without words, and sources without words, take 0. A null doc_id is an id of its own; ties are broken by
    hashes of the ids, so reruns and other partitionings agree. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    sizes = ws.put(docs.select("doc_id", "source", words("text").alias("size")), "sizes")
    targets = ws.put(source_targets(sizes, weights, share, ceiling), "targets")
    stats = targets.agg(F.count("*").alias("n"), F.max("units").alias("most")).first()
    by_source = (lambda t: F.broadcast(t)) if stats["n"] <= BROADCAST_SOURCES else (lambda t: t)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EPSILON)
    t = targets.select(F.col("source").alias("_s"), "rank", "source_size", "target", "units", whole.cast("long").alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"))
    rows = sizes.join(by_source(t), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    units = rows.where((F.col("size") > 0) & (F.col("p") > EPSILON)).groupBy("rank", "doc_id", "size").agg(F.count("*").alias("m"), F.first("p").alias("p"), F.first("units").alias("n"))
    units = units.select("rank", F.struct("doc_id", "size").alias("id"), (F.col("size") * F.col("m")).cast("double").alias("s"), "p", "n")
    more = pivotal_round(units, stats["most"] or 0, seed, ws).where("x = 1").select(F.col("rank").alias("_r"), F.col("id.doc_id").alias("_d"), F.col("id.size").alias("_z"), "x")
    out = rows.join(more, (F.col("rank") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("x", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
