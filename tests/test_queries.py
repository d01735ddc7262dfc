"""Each query against its DuckDB twin on the whole sf0.01 tables, for a cross-section of families."""

import os

import duckdb
import pytest

from hostweave.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = ["scan_auth", "limit_scan", "window_bound", "two_window_or", "pair_keys", "sample_start_time", "mixed_corpus", "weighted_choice_with_replacement", "edge_counts", "user_host_counts", "marginals", "is_server", "recover_redteam", "hard_negatives", "freeze_split", "host_users", "conditional_attributes", "build_features", "rarity_baseline", "pr_curve", "weighted_choice_wo_replacement", "generate_campaigns", "naive_mode", "max_jaccard", "v1_report", "ks_2samp", "scalar_functions"]


def rows_of(values, digits=6):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in values), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(*want.columns).collect()) == rows_of(want.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_a_twin_or_is_known_not_to():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"gbt_detector", "logistic_detector"}
