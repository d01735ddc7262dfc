import pytest
from pyspark.sql import functions as F

from hostweave.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("small", [True, False])
def test_keyed_joins_like_a_join(spark, monkeypatch, how, small):
    if not small:
        monkeypatch.setattr(common, "within", lambda df, *a: df)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.createDataFrame([(k, k * 2, 1000 if k == -7 else 40) for k in [-7, *range(0, 60, 2)]], "k long, v long, n long")
    want = sorted(map(str, rows.join(table.drop("n"), "k", how).select("k", "id", "v").collect()))
    assert sorted(map(str, common.keyed(rows, table, "k", "n", how, hot_rows=100).select("k", "id", "v").collect())) == want
    assert sorted(map(str, common.keyed(rows, table.drop("n"), "k", None, how, hot_rows=100).select("k", "id", "v").collect())) == want


def test_within_counts_rows_and_bytes(spark):
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(common.within(spark.range(10))) and not hint(common.within(spark.range(10), 9))
    assert not hint(common.within(spark.range(10).select(F.array("id").alias("x"))))


def test_left_over_intermediates_are_swept(spark):
    ws = common.Workspace(spark, "test")
    ws.put(spark.range(3), "t")
    assert common.sweep(spark) == 0 and ws.spark.read.parquet(f"{ws.root}/t").count() == 3
    fs, p = common.hadoop(spark, ws.root)
    fs.setTimes(p, 1000, -1)
    assert common.sweep(spark) == 1 and not fs.exists(p)
