"""Experiment drivers on sf0.01 with small jobs: what they hold on to matters here, not the numbers."""

import json

import pytest
from pyspark.sql import functions as F

from hostweave.operators import metrics, model, sampling
from hostweave.plans import experiments as X
from hostweave.schema import AUTH_COLS
from hostweave.sources import figures, logs

SF = "/root/testdata/sf0.01"
FEW = {"maxDepth": 2, "maxIter": 2, "stepSize": 0.3}


@pytest.fixture(scope="module")
def setting(spark):
    auth = logs.auth(spark, SF)
    config = logs.Config(n_campaigns=150, campaigns_per_point=40, k_values=[1, 2], n_seeds=2, base_rates=[0.2, 0.0001], gbt=FEW)
    return X.build_context(spark, auth, logs.auth_as_redteam(auth), config, benign=600)


def test_context_keeps_classes_apart_and_keys_by_the_event(setting):
    rows = setting.evaluation
    assert {r["label"] for r in rows.select("label").distinct().collect()} == {0, 1}
    again = setting.features_of(setting.negatives["holdout"].repartition(7), 0)
    key = lambda df: sorted(r["row_id"] for r in df.where("label = 0").select("row_id").collect())
    assert key(again) == key(rows)
    hard = setting.negatives["fit"].join(setting.red.select("src_computer", "dst_computer").distinct(), ["src_computer", "dst_computer"], "left_semi")
    assert hard.count() > 0 and hard.join(setting.positives("fit"), AUTH_COLS, "left_semi").count() == 0


def test_sweep_goes_on_where_it_stopped(spark, setting, tmp_path, monkeypatch):
    path, made = f"file://{tmp_path}/cells.json", []
    monkeypatch.setattr(X, "scarcity_point", lambda s, k, seed, params: made.append((k, seed)) or {"real": 0.1 * k, "augmented": 0.1 * k + 0.01 * seed})
    cells = X.sweep(setting, path)
    assert [(c["k"], c["seed"]) for c in cells] == [(1, 42), (1, 43), (2, 42), (2, 43)] == made
    X.sweep(setting, path, n_seeds=3)
    assert made[4:] == [(1, 44), (2, 44)]
    summary = {r["k"]: r for r in X.summarize(spark, logs.load_json(spark, path)).collect()}
    assert summary[1]["real_mean"] == pytest.approx(0.1) and summary[2]["n"] == 3 and summary[2]["wins"] == 3


def test_scarcity_point_trains_twice_and_never_on_the_evaluation(setting, monkeypatch):
    sizes, real = [], model.train_and_eval

    def seen(train, evaluation, *a, **k):
        sizes.append((train.where("label = 1").count(), evaluation is setting.evaluation))
        return real(train, evaluation, *a, **k)

    monkeypatch.setattr(X, "train_and_eval", seen)
    cell = X.scarcity_point(setting, 1, 42)
    assert 0 <= cell["real"] <= 1 and 0 <= cell["augmented"] <= 1
    assert sizes[0][0] < sizes[1][0] and all(x for _, x in sizes)


def test_too_few_campaigns_are_an_error_cell(setting):
    cells = X._cells([1], lambda seed: X.scarcity_point(setting, 10_000, seed), None, setting.spark, lambda seed: {"seed": seed})
    assert "campaigns asked for" in cells[0]["error"]


def test_baselines_ablation_and_base_rates_over_seeds(setting, monkeypatch):
    one = {}  # campaigns are generated once for each generator and seed
    real = X.synthetic
    monkeypatch.setattr(X, "synthetic", lambda s, f, n, seed, naive=False: one.setdefault((seed, naive), real(s, f, n, seed, naive)))
    b = X.baselines(setting, 1)
    assert set(b["means"]) == {"real", "tuned_only", "naive_only", "tuned_augmented", "naive_augmented"} and 0 < b["rarity"] <= 1
    assert {naive for _, naive in one} == {True, False} and len({seed for seed, _ in one}) == 1
    a = X.ablation(setting, 1)
    assert len(a["importance_real"]) == 8 and 0 <= a["structural_mass_real"] <= 1 + 1e-9 and a["means"]["real_full"]["n"] == 1
    r = X.baserate_sweep(setting, 2)
    cell = r["cells"][0]
    positives = setting.positives("holdout").count()
    assert cell["0.2_rows"] == positives * 5 and "negatives asked for" in cell["0.0001_error"] and cell["None_positives"] == positives
    assert r["means"]["0.2"]["n"] == 2


def test_leakcheck_counts_the_evaluation_rows_only(setting):
    out = X.leakcheck(setting)
    n = {x["label"]: x["n"] for x in out["fit"]["unseen"]}
    assert n == {0: setting.negatives["holdout"].count(), 1: setting.positives("holdout").count()}
    assert all(x["n_unseen"] == 0 for x in out["full"]["unseen"])  # nothing is new to a graph of everything
    assert 0 <= out["fit"]["benign_at_rt_p5"]["share"] <= 1


def test_validation_checks_and_charts(spark, setting, tmp_path):
    report = X.validation(setting, figures_to=f"file://{tmp_path}/charts")
    assert report["novelty"]["n_campaigns"] == 150 and {c["status"] for c in report["v1"]} <= {"pass", "n/a"}
    assert sorted(p.name for p in (tmp_path / "charts").glob("*.svg")) == ["breadth.svg", "creds.svg", "dt.svg", "hours.svg"]
    assert "<svg" in (tmp_path / "charts/breadth.svg").read_text() and "synthetic" in (tmp_path / "charts/breadth.svg").read_text()


def test_exit_checks_and_benchmark(setting, tmp_path):
    checks = X.exit_checks(setting, f"file://{tmp_path}/logs")
    assert [sum(c["stage"] == s for c in checks) for s in (1, 2, 3)] == [4, 4, 5]
    failed = {c["check"] for c in checks if not c["ok"]}
    # the adapter plants labelled events that the log lacks, and ten thousandths of so few rows isn't a rate
    assert "every labelled event is in the log" in failed and not failed & {"every generated edge is in the graph", "labels align with rows", "the written log parses as one"}
    b = X.benchmark(setting, rows=500, total=1_000_000)
    assert b["rows"] == 500 and b["full_pass_hours"] == pytest.approx(b["seconds"] * 2000 * X.PASSES / 3600, rel=0.05)


def test_command_line(spark, monkeypatch, tmp_path, capsys):
    assert X.main([]) == 2 and X.main(["nothing", SF]) == 2
    monkeypatch.setitem(X.TASKS, "leakcheck", lambda s, n: {"seeds": n})
    path = f"file://{tmp_path}/out.json"
    assert X.main(["leakcheck", SF, "7", "--out", path]) == 0
    assert logs.load_json(spark, path) == {"leakcheck": {"seeds": 7}}
    logs.save_json([{"k": 1, "seed": s, "real": 0.1, "augmented": 0.2 + s / 100} for s in (1, 2)], path, spark)
    assert X.main(["sweep", SF, "--out", path, "--figures", f"file://{tmp_path}", "--figure-only"]) == 0
    assert (tmp_path / "scarcity.svg").exists() and "scarcity.svg" in capsys.readouterr().out


def test_detectors(spark, setting):
    columns = X.COLUMNS
    rows = setting.train_negatives.select("label", *columns).unionByName(setting.real.select("label", *columns))
    fits = [model.train_and_eval(rows.repartition(n), setting.evaluation, columns, seed=3, params=FEW | {"subsamplingRate": 0.8}) for n in (2, 5)]
    scores = [sorted((r["row_id"], round(r["score"], 12)) for r in f.scored.select("row_id", "score").collect()) for f in fits]
    assert scores[0] == scores[1]  # however the rows lie in files
    assert fits[0].auc_pr == pytest.approx(metrics.average_precision(fits[0].scored).first()[0])
    found = fits[0].importances()
    assert set(found) == set(columns) and list(found.values()) == sorted(found.values(), reverse=True) and sum(found.values()) == pytest.approx(1)
    linear = model.train_and_eval(rows, setting.evaluation, columns, model="logistic")
    assert len(linear.importances()) == len(columns) and 0 < linear.auc_pr <= 1 and linear.curve().where("threshold IS NULL").count() == 1
    with pytest.raises(ValueError, match="forest"):
        model.train_and_eval(rows, setting.evaluation, columns, model="forest")


def test_large_draws_are_those_of_a_sort(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("time"))
    want = sorted(r["time"] for r in sampling.choice(rows, 3000, 1, "s", "time").collect())
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    large = sampling.choice(rows, 3000, 1, "s", "time")
    assert sorted(r["time"] for r in large.collect()) == want and large.columns == ["time"]
    assert sampling.choice(rows, 30_000, 1, "s", "time").count() == 20_000


def test_charts_and_small_files(spark, tmp_path):
    assert "<svg" in figures.chart({}, "t", "x", "y") and "&lt;" in figures.chart({"<": [(1, 2, 0.5), (None, 1)]}, "t", "x", "y")
    path = f"file://{tmp_path}/deep/x.json"
    assert logs.load_json(spark, path) is None
    for value in ({"a": 1}, [1, "é"]):
        logs.save_json(value, path, spark)
        assert logs.load_json(spark, path) == value == json.loads((tmp_path / "deep/x.json").read_text())
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["x.json"]
