"""Experiment drivers: scarcity sweep, baselines, ablation, base rates, validation, leak check, exit checks and benchmark.

Each cell is a job over cached feature tables; a driver loop runs the cells and results are small reports.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.operators import aggregates, features, generate, graph, metrics, profile, redteam, sampling, validate
from hostweave.operators.model import Fitted, train_and_eval
from hostweave.schema import AUTH_COLS, MALICIOUS, UNBOUNDED, FitWindow, between
from hostweave.sources import figures, logs
from hostweave.sources.shared import cut

COLUMNS = features.STRUCTURAL + features.ATTRIBUTE
#: Full passes over the log that a run makes: aggregates and the join with the labelled events.
PASSES = 6


@dataclass
class Setting:
    """Everything the cells share, computed once and kept."""

    spark: SparkSession
    config: logs.Config
    auth: DataFrame
    red: DataFrame
    benign: int = 1_500_000

    @cached_property
    def window(self) -> FitWindow:
        return FitWindow(self.config.t_hi)

    @cached_property
    def edges(self) -> DataFrame:
        return aggregates.edge_counts(self.auth, self.window).persist()

    @cached_property
    def edges_full(self) -> DataFrame:
        return aggregates.edge_counts(self.auth, UNBOUNDED).persist()

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.with_servers(graph.node_degrees(self.edges), self.config.server_in_degree_percentile, self.config.server_min_in_out_ratio).persist()

    @cached_property
    def user_host(self) -> DataFrame:
        return aggregates.user_host_counts(self.auth, self.window).persist()

    @cached_property
    def hourly(self) -> DataFrame:
        return aggregates.hourly_volume(self.auth, self.window).persist()

    @cached_property
    def split(self) -> DataFrame:
        matched = redteam.recover_redteam(self.auth, self.red)
        return cut(redteam.freeze_split(redteam.hop_index(redteam.sessionize(matched, self.config.campaign_gap_seconds)), self.config.fit_fraction), "split")

    @cached_property
    def fit(self) -> DataFrame:
        return self.split.where("side = 'fit'")

    def positives(self, side: str) -> DataFrame:
        return self.split.where(F.col("side") == side).select(*AUTH_COLS)

    @cached_property
    def negatives(self) -> dict[str, DataFrame]:
        """By side: benign rows drawn inside its window and off the attacked edges, and the hard negatives on those."""
        c = self.config
        sides = {"fit": (0, c.t_hi), "holdout": (c.t_hi + 1, c.collection_seconds)}
        hard = redteam.hard_negatives(self.auth, self.red, self.red, *sides.values())
        drawn = {s: sampling.benign_sample(self.auth, *w, self.benign, self.red, c.seed).select(*AUTH_COLS) for s, w in sides.items()}
        return {s: cut(drawn[s].unionByName(hard.where(F.col("side") == s).select(*AUTH_COLS)), f"negatives-{s}") for s in sides}

    def features_of(self, rows: DataFrame, label: int) -> DataFrame:
        """Features with label and row_id, which depends on the event alone, so that draws by it don't depend on partitions."""
        keyed = rows.withColumn("label", F.lit(label)).withColumn("row_id", F.xxhash64(F.lit(label), *AUTH_COLS))
        return features.build_features(keyed, self.edges, self.nodes, self.user_host, keep=("label", "row_id"))

    @cached_property
    def train_negatives(self) -> DataFrame:
        return cut(self.features_of(self.negatives["fit"], 0), "train-negatives")

    @cached_property
    def real(self) -> DataFrame:
        return cut(self.features_of(self.positives("fit"), 1), "real")

    @cached_property
    def evaluation(self) -> DataFrame:
        return cut(self.features_of(self.positives("holdout"), 1).unionByName(self.features_of(self.negatives["holdout"], 0)), "evaluation")


def build_context(spark: SparkSession, auth: DataFrame, red: DataFrame, config: logs.Config, benign: int = 1_500_000) -> Setting:
    return Setting(spark, config, auth, red, benign)


def seeds_of(config: logs.Config, n_seeds: int | None = None) -> list[int]:
    return [config.seed + i for i in range(n_seeds or config.n_seeds)]


def made_seed(seed: int, k: int) -> int:
    """The generator's seed of a cell: no two cells of a sweep share one."""
    return seed * 1000 + k


def synthetic(s: Setting, fit_rows: DataFrame, n: int, seed: int, naive: bool = False) -> tuple[DataFrame, dict]:
    """Log rows of n campaigns generated from the given fit rows only, and the generator's counts."""
    c = s.config
    made = cut(generate.generate(s.edges, s.nodes, s.user_host, profile.breadth_and_creds(fit_rows), profile.inter_event_dt(fit_rows), n, alpha=c.alpha, beta=c.beta, credential_bonus=c.credential_bonus, min_out_degree=c.min_foothold_out_degree, max_creds=c.max_harvested_creds, seed=seed, naive=naive), "campaigns")
    rows = generate.as_rows(generate.place(made, generate.start_times(made, s.hourly, c.collection_seconds, seed)))
    return cut(rows, "synthetic"), generate.corpus_stats(made).first().asDict()


def _score(s: Setting, positives: list[DataFrame], seed: int, columns: list[str] = COLUMNS, params: dict | None = None) -> Fitted:
    train = s.train_negatives.select("label", *columns)
    for p in positives:
        train = train.unionByName(p.select("label", *columns))
    return train_and_eval(train, s.evaluation, columns, seed=seed, params=params or s.config.gbt)


def _cells(seeds: list[int], one: Callable[[int], dict], path: str | None, spark: SparkSession, key: Callable[[int], dict]) -> list[dict]:
    """A cell for each seed; those that the file at path has are taken from it, others are added to it as soon as they are there."""
    cells = logs.load_json(spark, path) if path else None
    cells = cells if isinstance(cells, list) else []
    for seed in seeds:
        name = key(seed)
        if any(all(c.get(k) == v for k, v in name.items()) and "error" not in c for c in cells):
            continue
        began = time.perf_counter()
        try:
            cell = name | one(seed)
        except ValueError as e:
            cell = name | {"error": str(e)}
        cells.append(cell | {"seconds": round(time.perf_counter() - began, 1)})
        if path:
            logs.save_json(cells, path, spark)
    return cells


def scarcity_point(s: Setting, k: int, seed: int, params: dict | None = None) -> dict:
    """Average precision with k real campaigns, without and with campaigns generated from those k alone."""
    drawn = s.fit.join(sampling.draw_campaigns(s.fit, k, seed), "campaign_id", "left_semi")
    real = s.features_of(drawn.select(*AUTH_COLS), 1).persist()
    rows, stats = synthetic(s, drawn, s.config.campaigns_per_point, made_seed(seed, k))
    made = s.features_of(rows.select(*AUTH_COLS), 1).persist()
    out = {"real": _score(s, [real], seed, params=params).auc_pr, "augmented": _score(s, [real, made], seed, params=params).auc_pr, "cap_rate": stats["cap_rate"]}
    real.unpersist()
    made.unpersist()
    return out


def sweep(s: Setting, path: str | None = None, n_seeds: int | None = None, params: dict | None = None) -> list[dict]:
    """All cells; each is written as soon as it is there, a failed one is kept with its error, and done ones of an earlier run are taken over."""
    cells: list[dict] = []
    for k in s.config.k_values:
        found = _cells(seeds_of(s.config, n_seeds), lambda seed: scarcity_point(s, k, seed, params), path, s.spark, lambda seed: {"k": k, "seed": seed})  # noqa: B023
        cells = found if path else cells + found  # a file holds the cells of every k
    return cells


def summarize(spark: SparkSession, cells: list[dict]) -> DataFrame:
    """Per k: mean and interval of both arms and the paired test of their lift."""
    rows = spark.createDataFrame([(c["k"], c["seed"], c["real"], c["augmented"]) for c in cells if "error" not in c], "k long, seed long, real double, augmented double")
    real = metrics.mean_ci(rows, "real", "k").withColumnsRenamed({"mean": "real_mean", "ci": "real_ci"})
    made = metrics.mean_ci(rows, "augmented", "k").withColumnsRenamed({"mean": "augmented_mean", "ci": "augmented_ci"}).drop("n")
    return real.join(made, "k").join(metrics.paired_test(rows, "real", "augmented", "k").drop("n"), "k")


def means(spark: SparkSession, cells: list[dict], names: list[str]) -> dict[str, dict]:
    """Mean and interval of each named number over the cells that have it."""
    rows = [(n, float(c[n])) for c in cells if "error" not in c for n in names if c.get(n) is not None]
    found = metrics.mean_ci(spark.createDataFrame(rows, "name string, value double"), "value", "name").collect()
    return {r["name"]: {"n": r["n"], "mean": r["mean"], "ci": r["ci"]} for r in found}


def baselines(s: Setting, n_seeds: int | None = None, params: dict | None = None) -> dict:
    """Per seed: real only, tuned and naive synthetic alone (tested on real), and both added to real; and rarity alone, which has no seed.

    Tuned and naive campaigns have the same seed, number and distributions: only the weights and credentials differ.
    """
    k = max(s.config.k_values)
    arms = ["real", "tuned_only", "naive_only", "tuned_augmented", "naive_augmented"]

    def one(seed: int) -> dict:
        out = {"real": _score(s, [s.real], seed, params=params).auc_pr}
        for name in ("tuned", "naive"):
            rows, stats = synthetic(s, s.fit, s.config.campaigns_per_point, made_seed(seed, k), naive=name == "naive")
            made = s.features_of(rows.select(*AUTH_COLS), 1).persist()
            out |= {f"{name}_only": _score(s, [made], seed, params=params).auc_pr, f"{name}_augmented": _score(s, [s.real, made], seed, params=params).auc_pr, f"cap_rate_{name}": stats["cap_rate"]}
            made.unpersist()
        return out

    cells = _cells(seeds_of(s.config, n_seeds), one, None, s.spark, lambda seed: {"seed": seed})
    return {"cells": cells, "means": means(s.spark, cells, arms), "rarity": metrics.average_precision(s.evaluation, "edge_rarity").first()[0]}


def ablation(s: Setting, n_seeds: int | None = None, params: dict | None = None) -> dict:
    """Per seed: real and augmented training with all features and with the structural ones, which are a slice of the same tables; importances of the full models, averaged over seeds."""
    k = max(s.config.k_values)
    names = [f"{arm}_{columns}" for arm in ("real", "augmented") for columns in ("full", "structural")]

    def one(seed: int) -> dict:
        rows, _ = synthetic(s, s.fit, s.config.campaigns_per_point, made_seed(seed, k))
        made, out = s.features_of(rows.select(*AUTH_COLS), 1).persist(), {}
        for arm, positives in (("real", [s.real]), ("augmented", [s.real, made])):
            full = _score(s, positives, seed, params=params)
            out |= {f"{arm}_full": full.auc_pr, f"{arm}_structural": _score(s, positives, seed, features.STRUCTURAL, params).auc_pr, f"importance_{arm}": full.importances()}
        made.unpersist()
        return out

    cells = _cells(seeds_of(s.config, n_seeds), one, None, s.spark, lambda seed: {"seed": seed})
    report: dict = {"cells": cells, "means": means(s.spark, cells, names)}
    for arm in ("real", "augmented"):
        found = [c[f"importance_{arm}"] for c in cells if "error" not in c]
        average = {f: sum(x[f] for x in found) / len(found) for f in found[0]} if found else {}
        report[f"importance_{arm}"] = dict(sorted(average.items(), key=lambda x: (-x[1], x[0]))[:8])
        report[f"structural_mass_{arm}"] = sum(v for f, v in average.items() if f in features.STRUCTURAL)
    return report


def baserate_sweep(s: Setting, n_seeds: int | None = None, params: dict | None = None) -> dict:
    """Per seed one model, scored once; then all positives with ever more negatives, up to all of them."""
    rates = [*s.config.base_rates, None]

    def one(seed: int) -> dict:
        scored, out = _score(s, [s.real], seed, params=params).scored.persist(), {}
        for rate in rates:
            try:
                r = metrics.average_precision(sampling.downsample_eval(scored, rate, seed, "row_id")).first()
                out |= {str(rate): r[0], f"{rate}_positives": r["positives"], f"{rate}_rows": r["rows"]}
            except ValueError as e:
                out |= {str(rate): None, f"{rate}_error": str(e)}
        scored.unpersist()
        return out

    cells = _cells(seeds_of(s.config, n_seeds), one, None, s.spark, lambda seed: {"seed": seed})
    return {"cells": cells, "means": means(s.spark, cells, [str(r) for r in rates])}


def validation(s: Setting, seed: int | None = None, figures_to: str | None = None) -> dict:
    """Novelty, hard constraints and fidelity of n_campaigns synthetic campaigns; figures_to: a folder for the charts."""
    rows, stats = synthetic(s, s.fit, s.config.n_campaigns, seed if seed is not None else s.config.seed)
    report = {"generator": stats, "novelty": validate.novelty_summary(rows, s.fit).first().asDict(), "jaccard": validate.jaccard_quantiles(rows, s.fit).first().asDict(), "v1": [r.asDict() for r in validate.v1_checks(rows, s.edges, s.config.collection_seconds).collect()]}
    for what in ("breadth", "creds", "dt"):
        values = validate.two_sided(rows, s.fit, what).persist()
        ks = metrics.ks_statistic(values).first()
        report[f"ks_{what}"] = {"d": ks["ks"], "p": metrics.ks_p(ks["ks"], ks["n_a"], ks["n_b"])}
        report[f"histogram_{what}"] = [r.asDict() for r in metrics.overlay_histogram(values, log=what == "dt").orderBy("side", "bin").collect()]
        values.unpersist()
    report["js_in_degree"] = metrics.js_divergence(validate.two_sided(rows, s.fit, "in_degree", s.nodes)).first()[0]
    report["hours"] = [r.asDict() for r in aggregates.hour_share(rows).orderBy("hour").collect()]
    report["business_hours"] = aggregates.business_hours_share(rows).first()[0]
    if figures_to:
        draw(report, figures_to, s.spark)
    return report


def draw(report: dict, folder: str, spark: SparkSession) -> list[str]:
    """The charts of a validation report or of a sweep's cells, as SVG files."""
    out = []
    for what in ("breadth", "creds", "dt"):
        if rows := report.get(f"histogram_{what}"):
            sides = {name: [(r["bin"], r["density"]) for r in rows if r["side"] == side] for side, name in ((0, "synthetic"), (1, "real"))}
            out.append(figures.save_chart(sides, f"{folder}/{what}.svg", what, "bin", "density", spark, bars=True))
    if rows := report.get("hours"):
        out.append(figures.save_chart({"synthetic": [(r["hour"], r["share"]) for r in rows]}, f"{folder}/hours.svg", "hour of day", "hour", "share", spark, bars=True))
    if rows := report.get("summary"):
        arms = {arm: [(r["k"], r[f"{arm}_mean"], r[f"{arm}_ci"]) for r in rows] for arm in ("real", "augmented")}
        out.append(figures.save_chart(arms, f"{folder}/scarcity.svg", "average precision by real campaigns", "campaigns", "average precision", spark))
    return out


def leakcheck(s: Setting) -> dict:
    """On the bounded and the unbounded graph: how many evaluation rows of each class lie on an edge that it has never seen, and how many negatives are as rare as the positives' 5th percentile."""
    rows = s.positives("holdout").withColumn("label", F.lit(1)).unionByName(s.negatives["holdout"].withColumn("label", F.lit(0))).persist()
    out: dict = {}
    for arm, edges in (("fit", s.edges), ("full", s.edges_full)):
        scored = features.edge_rarity(rows, edges)
        out[arm] = {"unseen": [r.asDict() for r in validate.unseen_edge_rate(rows, edges, "label").orderBy("label").collect()], "benign_at_rt_p5": validate.benign_at_rarity(scored).first().asDict()}
    rows.unpersist()
    return out


def exit_checks(s: Setting, folder: str | None = None) -> list[dict]:
    """The checks that end each stage: (stage, check, ok, value). folder: where to write and read back the mixed logs; without it those checks work on the tables."""
    out: list[dict] = []

    def check(stage: int, name: str, ok: bool, value) -> None:
        out.append({"stage": stage, "check": name, "ok": bool(ok), "value": value})

    sizes = [df.count() for df in (s.edges, s.edges_full)]
    check(1, "both graphs are there", min(sizes) > 0, sizes)
    lost = redteam.unmatched(redteam.recover_redteam(s.auth, s.red), s.red).count()
    check(1, "every labelled event is in the log", lost == 0, lost)
    sides = {r["side"]: r["count"] for r in s.split.groupBy("side").count().collect()}
    check(1, "the split has both sides and is written once", set(sides) == {"fit", "holdout"}, sides)
    nodes, fit = s.nodes, s.fit
    parts = {"chain_length": fit, "inter_event_dt": profile.inter_event_dt(fit), "seed_hosts": profile.seed_hosts(fit, nodes), "target_indegree": profile.target_indegree(fit, nodes), "conditional_attributes": profile.conditional_attributes(fit, nodes), "credential_reuse": profile.credential_reuse(fit)}
    empty = [name for name, df in parts.items() if df.isEmpty()]
    check(1, "the profile has every distribution", not empty, empty)

    began = time.perf_counter()
    rows, stats = synthetic(s, fit, s.config.n_campaigns, s.config.seed)
    seconds = round(time.perf_counter() - began, 1)
    check(2, "campaigns are generated and placed within a minute", seconds < 60 and stats["n"] == s.config.n_campaigns, {"seconds": seconds, "campaigns": stats["n"]})
    off = graph.off_graph(rows, s.edges).count()
    check(2, "every generated edge is in the graph", off == 0, off)
    check(2, "footholds seldom cap the breadth", stats["cap_rate"] < 0.2, stats["cap_rate"])
    middle = {name: df.agg(F.expr("percentile(CAST(breadth AS DOUBLE), 0.5)")).first()[0] for name, df in (("synthetic", profile.breadth_and_creds(rows)), ("real", profile.breadth_and_creds(fit)))}
    check(2, "synthetic and real breadths have medians", None not in middle.values(), middle)

    n = rows.count()
    if folder:
        logs.write_auth_csv(rows, f"{folder}/synthetic")
        back = logs.scan_auth(s.spark, f"{folder}/synthetic")
    else:
        back = rows.select(*AUTH_COLS)
    check(3, "the written log parses as one", back.count() == n and back.columns == AUTH_COLS, n)
    outside = back.where(~F.expr(" AND ".join(f"{k} = '{v}'" for k, v in MALICIOUS.items()))).count()
    check(3, "attributes keep to their domains", outside == 0, outside)
    labels = rows.select(F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("first"), F.max("row_id").alias("last")).first()
    check(3, "labels align with rows", (labels["ids"], labels["first"], labels["last"]) == (n, 0, n - 1), labels.asDict())
    rates = {}
    for rate in s.config.base_rates:
        mixed = sampling.mixed_corpus(rows, s.negatives["fit"], rate, s.config.seed).groupBy("is_malicious").count().collect()
        found = {r["is_malicious"]: r["count"] for r in mixed}
        rates[rate] = found.get(1, 0) / max(1, found.get(0, 0))
    check(3, "mixes have their rates within a fifth", all(abs(r - rate) <= 0.2 * rate for rate, r in rates.items()), rates)
    check(3, "share of synthetic events in business hours is known", True, aggregates.business_hours_share(rows).first()[0])
    return out


def benchmark(s: Setting, rows: int = 10_000_000, total: int | None = None, budget_hours: float = 4.0) -> dict:
    """Seconds of the edge aggregate over the first `rows` rows, and what a run's full passes would take over `total` (by default the log's)."""
    pairs = s.auth.select("src_computer", "dst_computer").limit(rows).groupBy("src_computer", "dst_computer").agg(F.count("*").alias("weight"))
    began = time.perf_counter()
    seen = pairs.agg(F.sum("weight")).first()[0] or 0
    seconds = time.perf_counter() - began
    hours = seconds * (total if total is not None else s.auth.count()) / max(1, seen) * PASSES / 3600
    advice = None if hours <= budget_hours else "bound the log by time, for example to the fit window"
    return {"rows": seen, "seconds": round(seconds, 3), "full_pass_hours": hours, "within_budget": hours <= budget_hours, "advice": advice, "bounded_rows": s.auth.where(between(s.auth, None, s.config.t_hi)).count()}


TASKS: dict[str, Callable[[Setting, int | None], object]] = {
    "baselines": baselines, "ablation": ablation, "baserate": baserate_sweep, "validate": lambda s, n: validation(s), "leakcheck": lambda s, n: leakcheck(s),
}
OTHERS: dict[str, Callable[[Setting, int | None], object]] = {"checks": lambda s, n: exit_checks(s), "benchmark": lambda s, n: benchmark(s)}


def main(args: list[str]) -> int:
    """python -m hostweave.plans.experiments sweep|all|<task> SF_DIR [N_SEEDS] [--out FILE.json] [--figures FOLDER] [--figure-only]"""
    parser = argparse.ArgumentParser(prog="experiments", description=main.__doc__)
    parser.add_argument("task", choices=["sweep", "all", *TASKS, *OTHERS])
    parser.add_argument("sf_dir")
    parser.add_argument("n_seeds", nargs="?", type=int)
    parser.add_argument("--out")
    parser.add_argument("--figures")
    parser.add_argument("--figure-only", action="store_true", help="draw the charts of the report in --out again, without any run")
    try:
        given = parser.parse_args(args)
    except SystemExit:
        return 2
    spark = logs.session("hostweave-experiments")
    if given.figure_only:
        report = logs.load_json(spark, given.out)
        report = {"summary": [r.asDict() for r in summarize(spark, report).orderBy("k").collect()]} if isinstance(report, list) else report.get("validate", report)
        print(draw(report, given.figures or ".", spark))
        return 0
    auth = logs.auth(spark, given.sf_dir)
    setting = build_context(spark, auth, logs.auth_as_redteam(auth), logs.Config())
    if given.task == "sweep":
        cells = sweep(setting, given.out, given.n_seeds)
        result: object = {"cells": cells, "summary": [r.asDict() for r in summarize(spark, cells).orderBy("k").collect()]}
        if given.figures:
            draw(result, given.figures, spark)
    else:
        result = {n: (TASKS | OTHERS)[n](setting, given.n_seeds) for n in (TASKS if given.task == "all" else [given.task])}
        if given.figures and "validate" in result:
            draw(result["validate"], given.figures, spark)
        if given.out:
            logs.save_json(result, given.out, spark)
    print(result)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
