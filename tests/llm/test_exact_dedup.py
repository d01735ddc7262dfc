import hashlib
import re

from pyspark.sql import functions as F

from hostweave.llm import exact_dedup as E
from hostweave.llm.common import Workspace, keyed

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows):
    groups = {}
    for i, x in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append((-len(x or ""), i is None, i))
    out, seen = [], set()
    for i, x in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", x or "")
        best = min(groups[norm])
        keep, first = best[2], (-len(x or ""), i is None, i) == best and norm not in seen
        if first:
            seen.add(norm)
        out.append((i, keep, len(groups[norm]), first, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (7, "a b"), (8, "ab"), (5, "a\x0bb"), (6, "a b"), (9, "AB"), (4, "é" * 70_000), (None, "solo"), (None, "a\nb"), (10, "a b"), (10, "a b"), (10, "other")]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA).selectExpr("*", "1 AS key", "'x' AS text_sha256", "3 AS group_size")
    assert got(E.exact_dedup(docs)) == brute(rows)


def test_a_repeated_row_is_kept_once(spark):
    rows = [(10, "a b"), (10, "a  b"), (10, "a\n b"), (11, "ab"), (12, "z"), (12, "z"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA)
    out = E.exact_dedup(docs).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 2, False), (0, 2, True), (10, 4, False), (10, 4, False), (10, 4, False), (10, 4, True), (12, 2, False), (12, 2, True)]
    assert [r.doc_id for r in E.exact_dedup(docs.selectExpr("concat('d', doc_id) AS doc_id", "text")).where("kept AND group_size = 4").collect()] == ["d10"]


def test_directory_splits_overfull_buckets_only_and_the_result_stays(spark, monkeypatch):
    monkeypatch.setattr(E, "keyed", lambda *a, **k: keyed(*a, **k, hot_rows=2))  # most groups are hot
    rows = [(i, f"text {i % 300}" + " " * (i % 7)) for i in range(900)]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA)
    assert got(E.exact_dedup(docs, capacity=4)) == brute(rows)
    slots = spark.range(300).select(E.key_of(F.sha2(F.col("id").cast("string"), 256)).alias("key"), F.lit(1).alias("rows"))
    index, splits = E.directory(slots, 4, Workspace(spark, "test"))
    index = index.collect()
    assert len({r.key for r in index}) == 300 and len(splits) > 1 and splits == sorted(splits, reverse=True)
    buckets = {}
    for r in index:
        buckets.setdefault((r.bucket, r.depth), []).append(r.key)
    assert max(map(len, buckets.values())) <= 4 and len({d for _, d in buckets}) > 1
    assert all(b <= k < b + 2 ** (E.KEY_BITS - d) for (b, d), ks in buckets.items() for k in ks)


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(E, "key_of", lambda sha: F.conv(F.substring(sha, 1, 1), 16, 10).cast("long"))  # 16 keys for all texts
    rows = [(i, f"text {i % 50}") for i in range(150)]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA)
    assert got(E.exact_dedup(docs)) == brute(rows)


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
