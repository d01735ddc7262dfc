"""Exact dedup (8, native): an extendible-hash index of normalised texts in shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm.common import WHITESPACE, Workspace, keyed, within

KEY_BITS = 60
#: Slots of a bucket.
CAPACITY = 4096
#: Parts in which the rows of one text are gathered before its bucket's owner sees them.
SALTS = 16


def normalise(text: Column | str) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITESPACE, "")


def key_of(sha: Column) -> Column:
    """The first 60 bits of a hex SHA-256."""
    return F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long")


def directory(slots: DataFrame, capacity: int, ws: Workspace) -> tuple[DataFrame, list[int]]:
    """(key, rows, bucket, depth) of each slot, and the number of overfull buckets that each doubling split.

    A bucket holds the slots whose keys share their first `depth` bits and is named by the smallest key it may hold. The
    first depth is the one that would do for evenly spread keys. Buckets that hold more than the capacity are split
    by one bit more, and only their slots are dealt again; the others stay at their depth.
    """
    depth = max(0, math.ceil(math.log2(max(1, slots.count() / capacity))))
    left, done, splits = slots, [], []
    while True:
        bucket = F.shiftleft(F.shiftright("key", KEY_BITS - depth), KEY_BITS - depth) if depth else F.lit(0).cast("long")
        # keys are distinct and bits of a hash, so no bucket is much larger than another
        level = left.withColumn("bucket", bucket).withColumn("_n", F.count("*").over(Window.partitionBy("bucket")))
        level = ws.put(level.withColumn("depth", F.lit(depth)), f"depth{depth}")
        fits = (F.col("_n") <= capacity) | (F.col("depth") == KEY_BITS)
        done.append(level.where(fits).drop("_n"))
        left = level.where(~fits).select("key", "rows")
        overfull = level.where(~fits).select("bucket").distinct().count()
        if not overfull:
            break
        splits.append(overfull)
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, splits


def owned_chains(texts: DataFrame) -> DataFrame:
    """texts: bucket, key, norm and best, a row's (-length, no id, id, tag). Returns key, norm, best and n of each distinct text, as the owner of its bucket chains them.

    Rows of one text are first gathered in SALTS parts, each with partial sums at the map side. An owner task then has
    whole buckets, a range of keys; texts that collide in a slot are kept apart by comparing them byte by byte.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("part")
    gathered = texts.groupBy("bucket", "key", "norm", part).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    owned = gathered.repartitionByRange("bucket").sortWithinPartitions("bucket", "key")
    return owned.groupBy("bucket", "key", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after all white space is deleted. The row with the most code points in its original
    text stays, then the smallest doc_id (a null doc_id comes last). A null text is an empty text, and all empty texts
    are one group. Of rows that repeat a doc_id and an equal text one is kept; all count in group_size. An empty
    table gives an empty result; other columns are ignored. Ids of any ordered type will do.

    Index: a row's key is the first 60 bits of its text's SHA-256. Rows of one key are counted before the shuffle
    into one slot, so a hot group is a single slot. directory() deals slots to buckets, written as files by key range.
    Texts in slots of two rows or more are read again, and the owner of their bucket chains and compares them.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(normalise("text"), 256)
    entries = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), sha.alias("text_sha256")).withColumn("key", key_of(F.col("text_sha256")))
    entries = ws.put(entries.withColumn("tag", F.monotonically_increasing_id()), "entries")  # written, so that a tag stays a row's own
    slots = ws.put(entries.groupBy("key").agg(F.count("*").alias("rows")), "slots")
    indexed, _ = directory(slots, capacity, ws)
    indexed = ws.put(indexed.select("key", "rows", "bucket").repartitionByRange("bucket").sortWithinPartitions("key"), "index")

    chained = indexed.where("rows > 1")
    best = F.struct((-F.length("text").cast("long")).alias("n"), F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("id"))
    again = base.select(best.alias("best"), normalise("text").alias("norm")).withColumn("key", key_of(F.sha2("norm", 256)))
    again = keyed(again, chained, "key", "rows")
    chains = ws.put(owned_chains(again).select("key", F.sha2("norm", 256).alias("sha"), "best", "n"), "chains")

    heads = chains.where("n > 1").groupBy("key").agg(F.collect_list(F.struct("sha", "best", "n")).alias("heads")).join(slots, "key")  # a key has one text, or a few that collide
    found = keyed(entries, heads, "key", "rows", "left").withColumn("head", F.filter("heads", lambda h: h["sha"] == F.col("text_sha256"))[0])
    first = (F.col("n_chars") == -F.col("head.best.n")) & F.col("doc_id").eqNullSafe(F.col("head.best.id"))
    found = ws.put(found.select("doc_id", "text_sha256", "tag", "head", F.coalesce(first, F.lit(False)).alias("first")), "found")
    # where rows repeat the best id and length of a group, the one that was written first is kept
    tied = found.where("first").groupBy("text_sha256").agg(F.min("tag").alias("_t"), F.count("*").alias("_n")).where("_n > 1").select("_t", F.col("text_sha256").alias("_s"))
    mine = F.when(F.col("first"), F.col("text_sha256")).otherwise(F.col("tag").cast("string"))  # the rows of a hot group aren't dealt to one task
    found = found.withColumn("_j", mine).join(within(ws.put(tied, "tied")), F.col("_j") == F.col("_s"), "left")
    alone = F.col("head").isNull()
    kept = alone | (F.col("first") & (F.col("_t").isNull() | (F.col("_t") == F.col("tag"))))
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("head.best.id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("head.n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


#: DuckDB twin of the query.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
         count(*) OVER (PARTITION BY norm) AS group_size FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
