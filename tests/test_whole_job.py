"""Queries that once returned or did a part of their job only."""

import pytest
from pyspark.sql import functions as F

from hostweave.operators import generate, model
from hostweave.plans import context, registry
from hostweave.schema import EVENT_KEY
from hostweave.sources import logs

SF = "/root/testdata/sf0.001"


def test_pair_keys_returns_every_key(spark):
    auth = logs.auth(spark, SF)
    got = registry.QUERIES["pair_keys"](spark, SF)
    assert got.count() == auth.select(*EVENT_KEY).distinct().count()
    assert got.agg(F.sum("n")).first()[0] == auth.count()


def test_generator_makes_the_reference_number_of_campaigns(spark):
    config = logs.Config()
    assert (config.n_campaigns, config.campaigns_per_point, config.max_harvested_creds, config.n_seeds) == (10_000, 1000, 60, 5)
    assert registry.QUERIES["generate_campaigns"](spark, SF).select("campaign_id").distinct().count() == config.n_campaigns
    spark.catalog.clearCache()


def test_campaigns_that_hardly_fit_are_drawn_again_and_impossible_ones_raise(spark):
    hourly = spark.createDataFrame([(0, 1), (12, 200)], "hour long, cnt long")
    made = lambda longest: spark.createDataFrame([(i, longest) for i in range(30)], "campaign_id long, dt_offset long")
    month = 30 * 86400
    found = generate.start_times(made(month - 3600), hourly, month, 1)  # only hour 0 of day 0 will do
    assert found.count() == 30 and found.agg(F.max("start")).first()[0] <= 3600
    assert generate.start_times(made(month + 1), hourly, month, 1).count() == 0


def test_synth_rows_loses_no_campaign(spark):
    c = context.Context(spark, SF)
    c.__dict__["starts"] = spark.createDataFrame([(0, 5)], "campaign_id int, start long")
    c._synth[False] = spark.createDataFrame([(0, 0, 7, "u", "a", "b"), (1, 0, 7, "u", "a", "b")], "campaign_id int, hop_index int, dt_offset long, user string, src_computer string, dst_computer string")
    with pytest.raises(ValueError):
        c.synth_rows  # noqa: B018


@pytest.mark.parametrize("name", ["gbt_detector", "logistic_detector"])
def test_detectors_train_with_default_parameters(spark, monkeypatch, name):
    given, real = [], model.train_and_eval
    monkeypatch.setattr(model, "train_and_eval", lambda *a, **k: given.append(k.get("params")) or real(*a, **k))
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert given == [None]
    spark.catalog.clearCache()
