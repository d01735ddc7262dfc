"""Hand-computed answers on the small log of six events."""

import math

import pytest
from pyspark.sql import functions as F

from hostweave.operators import aggregates as A
from hostweave.operators import features as P
from hostweave.operators import generate as G
from hostweave.operators import graph, metrics, profile, redteam, sampling, validate
from hostweave.schema import AUTH_COLS, UNBOUNDED, FitWindow
from hostweave.sources import logs

LOG = """1,U1@D1,U1@D1,C1,C2,Ntlm,Network,LogOn,Success
2,U1@D1,U1@D1,C1,C2,Ntlm,Network,LogOn,Success
3,U2@D1,U2@D1,C2,C3,Kerberos,Interactive,LogOn,Success
4,U3@D1,U3@D1,C1,C3,Ntlm,Network,LogOn,Failure
3601,U2@D1,U2@D1,C3,C4,?,Network,LogOff,Success
7201,U4@D1,U4@D1,C4,C3,Kerberos,Network,LogOn,Success"""
RED = [(3, "U2@D1", "C2", "C3"), (7201, "U4@D1", "C4", "C3"), (99999, "U9@D1", "C9", "C9")]
REDTEAM = "time long, user string, src_computer string, dst_computer string"


@pytest.fixture(scope="module")
def auth(spark, tmp_path_factory):
    import gzip

    path = tmp_path_factory.mktemp("log") / "auth.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write(LOG + "\n")
    return logs.scan_auth(spark, str(path)).persist()


@pytest.fixture(scope="module")
def red(spark):
    return spark.createDataFrame(RED, REDTEAM)


def table(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_aggregates(auth):
    e = table(A.edge_counts(auth, UNBOUNDED), "src_computer", "dst_computer")
    assert len(e) == 5 and e["C1", "C2"].weight == 2 and e["C2", "C3"].weight == 1 and e["C4", "C3"].weight == 1
    u = table(A.user_host_counts(auth, UNBOUNDED), "user", "computer")
    assert [u[x].cnt for x in (("U1@D1", "C1"), ("U1@D1", "C2"), ("U2@D1", "C3"), ("U4@D1", "C3"))] == [2, 2, 2, 1]
    assert {r.hour: r.cnt for r in A.hourly_volume(auth, UNBOUNDED).collect()} == {0: 4, 1: 1, 2: 1}
    m = table(A.marginals(auth, UNBOUNDED), "column", "value")
    assert (m["auth_type", "Ntlm"].cnt, m["auth_type", "Kerberos"].cnt, m["auth_type", "?"].cnt) == (3, 2, 1)


def test_time_bound(auth):
    fit = FitWindow(4)
    assert A.edge_counts(auth, fit).count() == 3
    assert {r.hour: r.cnt for r in A.hourly_volume(auth, fit).collect()} == {0: 4}
    assert ("U4@D1", "C3") not in table(A.user_host_counts(auth, fit), "user", "computer")
    m = table(A.marginals(auth, fit), "column", "value")
    assert m["success", "Success"].cnt == 3 and m["success", "Failure"].cnt == 1 and ("auth_type", "?") not in m
    arms = table(A.edge_counts_arms(auth, fit), "src_computer", "dst_computer")
    assert arms["C3", "C4"].weight_fit == 0 and arms["C1", "C2"].weight_fit == 2
    with pytest.raises(TypeError):
        A.edge_counts(auth, 4)


def test_recovery_graph_and_attractiveness(auth, red):
    matched = redteam.recover_redteam(auth, red)
    assert matched.count() == 2 and redteam.unmatched(matched, red).count() == 1 and matched.columns == AUTH_COLS
    nodes = graph.with_servers(graph.node_degrees(A.edge_counts(auth, UNBOUNDED)), 75, 1.0)
    n = table(nodes, "host")
    assert len(n) == 4 and (n["C3"].in_degree, n["C3"].out_degree, n["C3"].in_out_ratio, n["C3"].is_server) == (3, 1, 1.5, True) and not n["C1"].is_server
    t = graph.target_attractiveness(red, nodes).first()
    assert (t.n_targets, t.median_target, t.median_all, t.ratio, t.keep) == (1, 3.0, 1.0, 3.0, True)


def test_sessions_and_split(spark):
    rows = spark.createDataFrame([(t, "U", "U", "A", f"B{t}", "x", "y", "z", "s") for t in (0, 60, 100000, 100060, 500000, 500060)], logs.AUTH_SCHEMA)
    s = redteam.sessionize(rows, 14400)
    assert [r.campaign_id for r in s.orderBy("time").collect()] == [0, 0, 1, 1, 2, 2]
    side = redteam.freeze_split(s, 0.7).groupBy("campaign_id").agg(F.first("side").alias("s")).collect()
    assert {r.campaign_id: r.s for r in side} == {0: "fit", 1: "fit", 2: "holdout"}
    one = redteam.freeze_split(s.where("campaign_id = 0"), 0.7)
    assert one.where("side = 'holdout'").count() == 0 and one.count() == 2


FEATURE_EDGES = [("A", "B", 3), ("A", "C", 1), ("B", "C", 6)]


def test_features(spark):
    edges = spark.createDataFrame(FEATURE_EDGES, "src_computer string, dst_computer string, weight long")
    nodes = graph.with_servers(graph.node_degrees(edges))
    uh = spark.createDataFrame([("U1", "A", 1), ("U1", "B", 1), ("U2", "C", 1)], "user string, computer string, cnt long")
    rows = spark.createDataFrame([(1, "U1", "U1", "A", "B", "NTLM", "Network", "LogOn", "Success"), (2, "U2", "U2", "B", "C", "?", "Odd", "LogOn", "Success"), (3, "U9", "U9", "X", "Y", None, None, "LogOn", "Success")], logs.AUTH_SCHEMA)
    out = table(P.build_features(rows, edges, nodes, uh, keep=("time",)), "time")
    assert out[1].edge_rarity == pytest.approx(math.log(10 / 3)) and out[2].edge_rarity == pytest.approx(math.log(10 / 6)) and out[3].edge_rarity == pytest.approx(math.log(20))
    assert (out[1].dst_in_degree, out[1].src_out_degree, out[1].n_hosts_for_cred) == (1, 2, 2) and (out[3].dst_in_degree, out[3].src_out_degree, out[3].n_hosts_for_cred) == (0, 0, 0)
    assert out[2].auth_unknown == 1 and out[2].logon_other == 1 and out[3].auth_other == 1 and all(sum(r[c] for c in P.ATTRIBUTE) == 2 for r in out.values())
    assert P.build_features(rows.limit(0), edges, nodes, uh).columns == P.STRUCTURAL + P.ATTRIBUTE and "credential_novelty" not in P.STRUCTURAL
    for bad in ((), ("other",)):
        with pytest.raises(ValueError):
            P.build_features(rows, edges, nodes, uh, groups=bad)


def generator_graph(spark):
    edges = spark.createDataFrame([("F", "T0", 5), ("F", "T1", 1), ("F", "T2", 3), ("F", "T3", 2), ("F", "T4", 7), ("F", "T5", 4)], "src_computer string, dst_computer string, weight long")
    uh = spark.createDataFrame([(u, "F", 1) for u in ("a", "b", "c")] + [("a", "T1", 1)], "user string, computer string, cnt long")
    return edges, graph.with_servers(graph.node_degrees(edges)), uh


def test_generator(spark):
    edges, nodes, uh = generator_graph(spark)
    breadth = spark.createDataFrame([(0, 10, 2), (1, 3, 2)], "idx long, breadth long, creds long")
    dts = spark.createDataFrame([(0, 60), (1, 30)], "idx long, dt long")
    made = lambda **k: G.generate(edges, nodes, uh, breadth, dts, 8, **({"min_out_degree": 2, "seed": 3} | k))
    rows = made().collect()
    per = {i: [r for r in rows if r.campaign_id == i] for i in range(8)}
    assert all(len(p) in (3, 6) and all(r.capped == (len(p) == 6) for r in p) and len({r.user for r in p}) <= 2 for p in per.values())
    assert all(len({r.dst_computer for r in p}) == len(p) and [r.dt_offset for r in sorted(p, key=lambda r: r.hop_index)] == sorted({r.dt_offset for r in p}) for p in per.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, made().collect())) and sorted(map(tuple, rows)) != sorted(map(tuple, made(seed=4).collect()))
    stats = G.corpus_stats(made()).first()
    assert stats.n == 8 and stats.attempts == 8 and stats.discard_rate == 0
    with pytest.raises(ValueError):
        made(min_out_degree=99)
    hourly = spark.createDataFrame([(9, 10)], "hour long, cnt long")
    placed = G.as_rows(G.place(made(), G.start_times(made(), hourly, 30 * 86400, 1)))
    assert placed.where("hop_index = 0").select((F.col("time") % 86400).alias("s")).where("s < 9 * 3600 OR s > 10 * 3600 + 60").count() == 0
    assert sorted(r.row_id for r in placed.collect()) == list(range(len(rows)))
    assert {r.check: r.status for r in validate.v1_checks(placed, edges, 30 * 86400).collect()} == {"timestamps_strictly_increasing": "pass", "within_collection_window": "pass", "edges_exist_in_graph": "pass", "no_credential_used_before_acquisition": "n/a"}
    with pytest.raises(ValueError):
        G.place(made(), G.start_times(made(), hourly, 10, 1))


def test_sampling(spark):
    assert sampling.rebalanced_sizes(1000, 100_000, 0.001) == (100, 100_000) and sampling.rebalanced_sizes(10, 100_000, 0.001) == (10, 10_000)
    scored = spark.range(2000).select("id", (F.col("id") < 10).cast("int").alias("label"))
    assert sampling.downsample_eval(scored, 0.1, 1, "id").groupBy("label").count().orderBy("label").collect()[0]["count"] == 90
    assert sampling.downsample_eval(scored, None, 1, "id").count() == 2000
    with pytest.raises(ValueError):
        sampling.downsample_eval(scored, 1e-6, 1, "id")
    with pytest.raises(ValueError):
        sampling.stack_classes([scored.drop("id")], scored)


def test_metrics(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 0), (0.4, 1), (0.1, 0)], "score double, label int")
    assert metrics.average_precision(scored).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics.pr_curve(scored).count() == 6
    v = spark.createDataFrame([(x, s) for x in (1, 2, 3) for s in (0, 1)], "value long, side int")
    assert metrics.ks_statistic(v).first().ks == 0 and metrics.js_divergence(v).first().js == pytest.approx(0)
    far = spark.createDataFrame([(1, 0), (1, 0), (10000, 1), (10000, 1)], "value long, side int")
    assert metrics.ks_statistic(far).first().ks == 1 and metrics.js_divergence(far).first().js > 0.9
    assert metrics.student_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4) and metrics.student_p(0.0, 5) == pytest.approx(1)
    big = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    assert all(r.cum_n == r.v + 1 for r in metrics.running_totals(big, "v", ["n"]).collect())


def test_equal_bins_of_a_histogram_have_one_width(spark):
    # 8 / 25 is no binary fraction, so edges that are added up differ in their last bits; 1317 / 3200 is a tie at 6 digits
    v = spark.range(10000).select(F.when(F.col("id") < 1317, 1).when(F.col("id") < 2634, 7).otherwise(9).alias("value"), F.lit(0).alias("side"))
    got = {r.bin: r.density for r in metrics.overlay_histogram(v).select("bin", F.round("density", 6).alias("density")).collect()}
    assert got == {0: 0.411563, 18: 0.411563, 24: 2.301875}


def test_novelty(spark):
    S = "campaign_id long, src_computer string, dst_computer string"
    synth = spark.createDataFrame([(0, "A", "B"), (0, "A", "C"), (1, "A", "C"), (1, "A", "D")], S)
    fit = spark.createDataFrame([(5, "A", "B"), (5, "A", "D")], S)
    assert {r.campaign_id: round(r.max_jaccard, 6) for r in validate.max_jaccard(synth, fit).collect()} == {0: 0.333333, 1: 0.333333}
    s = validate.novelty_summary(synth, fit.where("dst_computer = 'B'"), 0.5).first()
    assert s.edge_novelty_rate == pytest.approx(2 / 3) and s.pct_near_duplicate == 0.5


def test_profile_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "a", "x"), (0, 60, "b", "y"), (0, 120, "a", "z"), (1, 5, "a", "x")], "campaign_id long, time long, src_user string, dst_computer string")
    assert sorted((r.breadth, r.creds) for r in profile.breadth_and_creds(rows).collect()) == [(1, 1), (3, 2)]
    assert [r.dt for r in profile.inter_event_dt(rows).collect()] == [60, 60] and [r.dt for r in profile.inter_event_dt(rows.where("campaign_id = 1")).collect()] == [1]
    from hostweave.streaming.sessions import sessions_of

    events = spark.createDataFrame([(t,) for t in (0, 100, 201, 1000, 9000)], "time long")
    want = [(0, 100, 2), (201, 201, 1), (1000, 1000, 1)]
    assert sorted(tuple(r) for r in sessions_of(events, 100).collect())[:3] == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions_of(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 100).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("bursts").collect()) == want


def test_sinks(spark, auth, tmp_path):
    logs.write_auth_csv(auth, str(tmp_path / "csv"), single=True)
    assert sorted(map(str, logs.scan_auth(spark, str(tmp_path / "csv")).collect())) == sorted(map(str, auth.collect()))
    logs.ingest(auth, str(tmp_path / "days"))
    with pytest.raises(Exception, match="already exists"):
        logs.ingest(auth, str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert A.edge_counts(days, FitWindow(4)).count() == 3 and "PartitionFilters: [isnotnull(day" in A.edge_counts(days, FitWindow(4))._jdf.queryExecution().toString()
    (tmp_path / "c.yaml").write_text("seed: 3\n")
    assert logs.Config.from_yaml(str(tmp_path / "c.yaml")).seed == 3
