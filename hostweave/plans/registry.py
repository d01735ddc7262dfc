"""Named queries of the engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostweave.functions.hashrng import first_k_per, sql_race, sql_u, u
from hostweave.operators import aggregates as A
from hostweave.operators import features as P
from hostweave.operators import generate as G
from hostweave.operators import graph, metrics, profile, redteam, sampling, validate
from hostweave.plans.context import CONFIG, FIT, K4, SEED, TRIES, T, Context, with_tables
from hostweave.schema import AUTH_COLS, EVENT_KEY, UNBOUNDED, between

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAIR = ["src_computer", "dst_computer"]
LO, HI, BIN_LO = 86400, 604800, 1900000


def query(sql: str | None, *tables: str, extra: str = "", naive: bool = False):
    """Registers a function of a Context under its name, with a DuckDB twin over the named tables."""

    def add(f: Callable[[Context], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_tables(sql, *tables, extra=extra, naive=naive)
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


AUTH = ", ".join(AUTH_COLS)

# --- scans, filters, projections -------------------------------------------------------------------------------------


@query(f"SELECT event_id, {AUTH} FROM auth")
def scan_auth(c):
    return c.auth.select("event_id", *AUTH_COLS)


@query('SELECT time, "user", src_computer, dst_computer FROM redteam')
def scan_redteam(c):
    return c.redteam


@query("SELECT least(5000, count(*)) AS n FROM auth")
def limit_scan(c):
    """Events in an aggregate over the first 5000 rows; which rows those are isn't defined, only how many."""
    return c.auth.select(*PAIR).limit(5000).groupBy(*PAIR).agg(F.count("*").alias("weight")).agg(F.sum("weight").alias("n"))


@query("SELECT event_id, time FROM fit", "fit")
def window_bound(c):
    return c.auth.where(FIT.condition(c.auth)).select("event_id", "time")


@query(f"SELECT event_id, time FROM auth WHERE time BETWEEN {LO} AND {HI}")
def time_range(c):
    return c.auth.where(between(c.auth, LO, HI)).select("event_id", "time")


@query(f"SELECT event_id, time FROM auth WHERE time BETWEEN {LO} AND {HI} OR time BETWEEN {BIN_LO} AND 2000000")
def two_window_or(c):
    return c.auth.where(between(c.auth, LO, HI) | between(c.auth, BIN_LO, 2000000)).select("event_id", "time")


@query("SELECT event_id FROM auth a WHERE NOT EXISTS (SELECT 1 FROM redteam r WHERE r.src_computer = a.src_computer AND r.dst_computer = a.dst_computer)")
def edge_exclusion(c):
    return graph.without_edges(c.auth, c.redteam).select("event_id")


@query("SELECT event_id, EXISTS (SELECT 1 FROM edges e WHERE e.src_computer = a.src_computer AND e.dst_computer = a.dst_computer)::INT AS on_graph FROM auth a", "edges")
def edge_membership(c):
    return c.auth.join(c.edges.select(*PAIR, F.lit(1).alias("_e")), PAIR, "left").select("event_id", F.coalesce("_e", F.lit(0)).alias("on_graph"))


@query(f"SELECT {K4}, campaign_id FROM camp WHERE campaign_id IN (0, 2, 4, 6)", "camp")
def isin_subset(c):
    return c.campaigns.where(F.col("campaign_id").isin(0, 2, 4, 6)).select(*EVENT_KEY, "campaign_id")


@query("SELECT count(*) FILTER (m.auth_type IS NULL) AS n_null, count(m.auth_type) AS n_not_null FROM keys k LEFT JOIN matched m USING (time, src_user, src_computer, dst_computer)", "matched")
def null_predicates(c):
    j = redteam.event_keys(c.redteam).join(c.matched, EVENT_KEY, "left")
    return j.agg(F.count_if(F.col("auth_type").isNull()).alias("n_null"), F.count_if(F.col("auth_type").isNotNull()).alias("n_not_null"))


@query("SELECT count(*) FILTER (auth_type <> 'NTLM') AS n_other, count(*) AS n FROM matched", "matched")
def domain_subset(c):
    return c.matched.agg(F.count_if(~F.col("auth_type").isin("NTLM")).alias("n_other"), F.count("*").alias("n"))


@query("SELECT round(avg(CASE WHEN (time // 3600) % 24 BETWEEN 6 AND 17 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM auth")
def business_hours(c):
    return A.business_hours_share(c.auth).select(*r6("share"))


@query(f'SELECT DISTINCT time, "user" AS src_user, src_computer, dst_computer FROM redteam')
def project_rename(c):
    return redteam.event_keys(c.redteam)


@query(f"SELECT {K4}, count(*) AS n FROM auth GROUP BY ALL")
def pair_keys(c):
    return c.auth.groupBy(*EVENT_KEY).agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query(f"SELECT {AUTH} FROM matched", "matched")
def recover_redteam(c):
    return c.matched


@query(f"SELECT count(*) AS n_unmatched FROM keys WHERE ({K4}) NOT IN (SELECT ({K4}) FROM matched)", "matched")
def redteam_unmatched(c):
    return redteam.unmatched(c.matched, c.redteam).agg(F.count("*").alias("n_unmatched"))


def _hard(c):
    return redteam.hard_negatives(c.auth, c.redteam, c.redteam, (0, T), (T + 1, CONFIG.collection_seconds))


HARD = f"""hard AS (SELECT {AUTH}, CASE WHEN time BETWEEN 0 AND {T} THEN 'fit' ELSE 'holdout' END AS side FROM auth a WHERE (time BETWEEN 0 AND {T} OR time BETWEEN {T + 1} AND 2592000)
  AND EXISTS (SELECT 1 FROM redteam r WHERE r.src_computer = a.src_computer AND r.dst_computer = a.dst_computer)
  AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.time = a.time AND k.src_user = a.src_user AND k.src_computer = a.src_computer AND k.dst_computer = a.dst_computer))"""


@query("SELECT * FROM hard", "keys", extra=HARD)
def hard_negatives(c):
    return _hard(c)


@query(f"SELECT count(*) AS n FROM hard JOIN keys USING ({K4})", "keys", extra=HARD)
def redteam_overlap(c):
    return _hard(c).join(redteam.event_keys(c.redteam), EVENT_KEY, "left_semi").agg(F.count("*").alias("n"))


@query("SELECT src_computer, dst_computer FROM matched INTERSECT SELECT src_computer, dst_computer FROM hard", "matched", extra=HARD)
def class_edge_overlap(c):
    return redteam.class_edge_overlap(c.matched, _hard(c))


FEATURES = f"""structural AS (SELECT s.event_id, s.label, s.src_computer, s.dst_computer, s.src_user, s.auth_type, s.logon_type, edge_rarity, coalesce(d.in_degree, 0)::DOUBLE AS dst_in_degree,
  coalesce(o.out_degree, 0)::DOUBLE AS src_out_degree, coalesce(h.n, 0)::DOUBLE AS n_hosts_for_cred FROM scored s LEFT JOIN nodes d ON d.host = s.dst_computer LEFT JOIN nodes o ON o.host = s.src_computer
  LEFT JOIN (SELECT "user", count(DISTINCT computer) AS n FROM uh GROUP BY 1) h ON h."user" = s.src_user)"""


@query("SELECT event_id, dst_in_degree, src_out_degree, n_hosts_for_cred FROM structural", "scored", "nodes", "uh", extra=FEATURES)
def feature_lookup(c):
    return P.structural(c.labelled, c.edges, c.nodes, c.user_host).select("event_id", *P.STRUCTURAL[1:])


@query("SELECT campaign_id, c.dst_computer, count(*) AS n_known FROM (SELECT DISTINCT campaign_id, dst_computer FROM camp) c JOIN uh ON uh.computer = c.dst_computer JOIN (SELECT DISTINCT campaign_id, src_user FROM camp) p USING (campaign_id) WHERE p.src_user = uh.\"user\" GROUP BY ALL", "camp", "uh")
def target_intersect(c):
    creds, targets = c.campaigns.select("campaign_id", F.col("src_user").alias("user")).distinct(), c.campaigns.select("campaign_id", F.col("dst_computer").alias("computer")).distinct()
    known = creds.join(c.user_host, "user").select("campaign_id", "user", "computer").join(targets, ["campaign_id", "computer"], "left_semi")
    return known.groupBy("campaign_id", F.col("computer").alias("dst_computer")).agg(F.count("*").alias("n_known"))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM edges", "edges")
def edge_counts(c):
    return c.edges


@query(f"SELECT src_computer, dst_computer, count(*) AS weight_full, count(*) FILTER (time <= {T}) AS weight_fit FROM auth GROUP BY ALL")
def edge_counts_arms(c):
    return A.edge_counts_arms(c.auth, FIT)


@query("SELECT * FROM uh", "uh")
def user_host_counts(c):
    return c.user_host


@query("SELECT (time // 3600) % 24 AS hour, count(*) AS cnt FROM auth GROUP BY 1")
def hourly_volume(c):
    return A.hourly_volume(c.auth, UNBOUNDED)


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", {x} AS value, count(*) AS cnt FROM fit GROUP BY ALL" for x in ("auth_type", "logon_type", "auth_orientation", "success")), "fit")
def marginals(c):
    return A.marginals(c.auth, FIT)


@query(f"SELECT host, in_degree, out_degree, {s6('in_out_ratio')} FROM nodes", "nodes")
def node_degrees(c):
    return graph.node_degrees(c.edges).select("host", "in_degree", "out_degree", *r6("in_out_ratio"))


@query("SELECT host, is_server::INT AS is_server FROM nodes", "nodes")
def is_server(c):
    return c.nodes.select("host", F.col("is_server").cast("int").alias("is_server"))


@query(f"SELECT n_targets, {s6('median_target', 'median_all')}, round(median_target / median_all, 6) AS ratio, (median_target / median_all >= 1.5)::INT AS keep FROM (SELECT count(*) AS n_targets, quantile_cont(in_degree::DOUBLE, 0.5) AS median_target FROM nodes WHERE host IN (SELECT dst_computer FROM redteam)), (SELECT quantile_cont(in_degree::DOUBLE, 0.5) AS median_all FROM nodes)", "nodes")
def target_attractiveness(c):
    out = graph.target_attractiveness(c.redteam, c.nodes, CONFIG.target_keep_ratio)
    return out.select("n_targets", *r6("median_target", "median_all", "ratio"), F.col("keep").cast("int").alias("keep"))


@query("SELECT sum(weight)::DOUBLE AS total_weight FROM edges", "edges")
def total_weight(c):
    return A.total_weight(c.edges)


@query('SELECT "user", count(DISTINCT computer) AS n_hosts FROM uh GROUP BY 1', "uh")
def cred_host_counts(c):
    return A.cred_host_counts(c.user_host)


@query("SELECT computer, string_agg(DISTINCT \"user\", ',' ORDER BY \"user\") AS users FROM uh GROUP BY 1", "uh")
def host_users(c):
    return A.host_users(c.user_host).select("computer", F.array_join("users", ",").alias("users"))


@query("SELECT breadth, creds, idx FROM (SELECT row_number() OVER (ORDER BY campaign_id) - 1 AS idx, breadth, creds FROM (SELECT campaign_id, count(DISTINCT dst_computer) AS breadth, count(DISTINCT src_user) AS creds FROM split WHERE side = 'fit' GROUP BY 1))", "split")
def fanout_distributions(c):
    return c.breadth.select("breadth", "creds", F.col("idx").cast("long").alias("idx"))


@query("SELECT campaign_id, min(time) AS t_min, max(time) AS t_max FROM camp GROUP BY 1", "camp")
def campaign_span(c):
    return profile.campaign_table(c.campaigns).select("campaign_id", "t_min", "t_max")


@query("SELECT campaign_id, count(*) AS events, (SELECT median(n)::DOUBLE FROM (SELECT count(*)::DOUBLE AS n FROM camp GROUP BY campaign_id)) AS median_events FROM camp GROUP BY 1", "camp")
def chain_length(c):
    per = c.campaigns.groupBy("campaign_id").agg(F.count("*").alias("events"))
    return per.join(F.broadcast(per.agg(F.expr("percentile(CAST(events AS DOUBLE), 0.5)").alias("median_events"))))


@query("SELECT campaign_id, host, in_degree, out_degree FROM camp JOIN nodes ON host = src_computer WHERE hop_index = 0", "camp", "nodes")
def seed_hosts(c):
    return profile.seed_hosts(c.campaigns, c.nodes)


@query("SELECT campaign_id, hop_index, host, in_degree FROM camp JOIN nodes ON host = dst_computer", "camp", "nodes")
def target_indegree(c):
    return profile.target_indegree(c.campaigns, c.nodes).withColumn("hop_index", F.col("hop_index").cast("long"))


BUCKET = "CASE WHEN hop_index = 0 THEN '0' WHEN hop_index <= 2 THEN '1-2' ELSE '3+' END"


@query(f"SELECT concat_ws('|', CASE WHEN coalesce(is_server, false) THEN 'True' ELSE 'False' END, {BUCKET}, auth_orientation) AS condition, concat_ws('|', auth_type, logon_type, success) AS value, count(*) AS cnt FROM camp LEFT JOIN nodes ON host = dst_computer GROUP BY ALL", "camp", "nodes")
def conditional_attributes(c):
    return profile.conditional_attributes(c.campaigns, c.nodes)


@query('SELECT campaign_id, src_user AS "user", min(hop_index) AS first_hop FROM camp GROUP BY ALL', "camp")
def credential_reuse(c):
    return profile.credential_reuse(c.campaigns).withColumn("first_hop", F.col("first_hop").cast("long"))


@query(f"SELECT host, in_degree, out_degree, {s6('in_out_ratio')} FROM nodes ORDER BY in_degree DESC, host LIMIT 10", "nodes")
def hub_topn(c):
    return graph.hub_topn(c.nodes, 10).select("host", "in_degree", "out_degree", *r6("in_out_ratio"))


@query("SELECT quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.75) AS p75 FROM (SELECT coalesce(in_degree, 0)::DOUBLE AS d FROM auth LEFT JOIN nodes ON host = dst_computer)", "nodes")
def dst_indegree_quantiles(c):
    return profile.indegree_quantiles(c.auth, c.nodes)


@query("SELECT h.range AS hour, round(coalesce(n / (SELECT count(*) FROM matched), 0.0::DOUBLE), 6) AS share FROM range(24) h LEFT JOIN (SELECT (time // 3600) % 24 AS hour, count(*)::DOUBLE AS n FROM matched GROUP BY 1) m ON m.hour = h.range", "matched")
def value_share(c):
    return A.hour_share(c.matched).select("hour", *r6("share"))


@query("SELECT label, " + ", ".join(f"round(avg(({x})::INT::DOUBLE), 6) AS {n}" for n, x in (("ntlm", "auth_type = 'NTLM'"), ("self_auth", "src_computer = dst_computer"), ("machine", "src_user LIKE '%$@%'"), ("same_user", "src_user = dst_user"))) + " FROM labelled GROUP BY 1", "labelled")
def attribute_share(c):
    return profile.attribute_share(c.labelled, "label").select("label", *r6("ntlm", "self_auth", "machine", "same_user"))


@query("SELECT campaign_id, count(*) AS events, count(DISTINCT dst_computer) AS targets, count(DISTINCT src_computer) AS sources, count(DISTINCT src_user) AS creds, min(time) AS t_min, max(time) AS t_max, max(time) - min(time) AS duration FROM camp GROUP BY 1", "camp")
def campaign_table(c):
    return profile.campaign_table(c.campaigns)


@query("SELECT count(*) AS n FROM camp a WHERE EXISTS (SELECT 1 FROM camp b WHERE b.campaign_id = a.campaign_id AND b.dst_computer = a.src_computer AND b.time < a.time)", "camp")
def chained_links(c):
    return redteam.chained_links(c.campaigns).agg(F.count("*").alias("n"))


@query("SELECT label, median(coalesce(weight, 0)::DOUBLE) AS median_weight FROM labelled LEFT JOIN edges USING (src_computer, dst_computer) GROUP BY 1", "labelled", "edges")
def edge_weight_median_by_class(c):
    w = c.labelled.join(c.edges, PAIR, "left").withColumn("w", F.coalesce("weight", F.lit(0)).cast("double"))
    return w.groupBy("label").agg(F.expr("percentile(w, 0.5)").alias("median_weight"))


# --- sequences -------------------------------------------------------------------------------------------------------


@query(f"SELECT {K4}, campaign_id FROM camp", "camp")
def sessionize(c):
    return c.campaigns.select(*EVENT_KEY, "campaign_id")


@query("SELECT campaign_id, min(time) AS start, max(time) AS \"end\", count(*) AS events FROM camp GROUP BY 1", "camp")
def session_windows(c):
    from hostweave.streaming.sessions import sessions_of

    s = sessions_of(c.matched, CONFIG.campaign_gap_seconds)
    return s.select((F.row_number().over(Window.orderBy("start")) - 1).cast("long").alias("campaign_id"), "start", "end", "events")


@query(f"SELECT {K4}, campaign_id, side FROM split", "split")
def freeze_split(c):
    return c.split.select(*EVENT_KEY, "campaign_id", "side")


@query(f"SELECT {K4}, hop_index FROM camp", "camp")
def hop_index(c):
    return c.campaigns.select(*EVENT_KEY, F.col("hop_index").cast("long").alias("hop_index"))


@query(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM camp GROUP BY 1", "camp")
def hop_bucket(c):
    return c.campaigns.groupBy(profile.hop_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT dt, count(*) AS n FROM (SELECT time - lag(time) OVER (PARTITION BY campaign_id ORDER BY time) AS dt FROM split WHERE side = 'fit') WHERE dt > 0 GROUP BY 1", "split")
def inter_event_dt(c):
    return c.dts.groupBy("dt").agg(F.count("*").alias("n"))


@query("SELECT campaign_id, hop_index, time - lag(time) OVER (PARTITION BY campaign_id ORDER BY hop_index) AS dt FROM synth_rows", "synth_rows")
def emission_dt(c):
    return c.synth_rows.select(F.col("campaign_id").cast("long").alias("campaign_id"), F.col("hop_index").cast("long").alias("hop_index"), (F.col("time") - F.lag("time").over(Window.partitionBy("campaign_id").orderBy("hop_index"))).alias("dt"))


@query("SELECT attempt, hop_index, dt_offset FROM synth", "synth")
def offsets(c):
    return c.synth().select("attempt", F.col("hop_index").cast("long").alias("hop_index"), "dt_offset")


@query("SELECT row_id, campaign_id, hop_index FROM synth_rows", "synth_rows")
def row_id(c):
    return c.synth_rows.select("row_id", F.col("campaign_id").cast("long").alias("campaign_id"), F.col("hop_index").cast("long").alias("hop_index"))


MIX_RATE = 0.01
MIXED = f"""benign AS (SELECT {AUTH}, event_id FROM labelled WHERE label = 0),
mal AS (SELECT {AUTH}, row_id AS event_id FROM synth_rows),
cnt AS (SELECT (SELECT count(*) FROM mal) AS m, (SELECT count(*) FROM benign) AS b),
sz AS (SELECT CASE WHEN {MIX_RATE}::DOUBLE * b <= m THEN round_even({MIX_RATE}::DOUBLE * b, 0)::BIGINT ELSE m END AS nm, CASE WHEN {MIX_RATE}::DOUBLE * b <= m THEN b ELSE least(b, round_even(m / {MIX_RATE}::DOUBLE, 0)::BIGINT) END AS nb FROM cnt),
pick AS (SELECT {AUTH}, 1 AS is_malicious, {sql_u(SEED, 'mix-malicious', *EVENT_KEY)} AS u FROM mal QUALIFY row_number() OVER (ORDER BY u, {K4}) <= (SELECT nm FROM sz)
  UNION ALL SELECT {AUTH}, 0, {sql_u(SEED, 'mix-benign', *EVENT_KEY)} AS u FROM benign QUALIFY row_number() OVER (ORDER BY u, {K4}) <= (SELECT nb FROM sz)),
mixed AS (SELECT {AUTH}, is_malicious, row_number() OVER (ORDER BY time, is_malicious DESC, u, {K4}) - 1 AS row_id FROM pick)"""


def _mixed(c):
    return sampling.mixed_corpus(c.synth_rows, c.labelled.where("label = 0"), MIX_RATE, SEED)


@query("SELECT row_id, time, is_malicious FROM mixed", "labelled", "synth_rows", extra=MIXED)
def stable_sort(c):
    return _mixed(c).select("row_id", "time", "is_malicious")


@query(f"SELECT row_id, {AUTH}, is_malicious FROM mixed", "labelled", "synth_rows", extra=MIXED)
def mixed_corpus(c):
    return _mixed(c).select("row_id", *AUTH_COLS, "is_malicious")


@query("SELECT nm AS n_malicious, nb AS n_benign FROM sz", "labelled", "synth_rows", extra=MIXED)
def class_rebalance(c):
    m, b = sampling.rebalanced_sizes(c.synth_rows.count(), c.labelled.where("label = 0").count(), MIX_RATE)
    return c.spark.range(1).select(F.lit(m).cast("long").alias("n_malicious"), F.lit(b).cast("long").alias("n_benign"))


# --- sorts, top-k, draws ---------------------------------------------------------------------------------------------


@query("SELECT (time // 86400) AS day, count(*) AS cnt FROM auth GROUP BY 1 ORDER BY 1")
def order_by(c):
    return A.events_per_day(c.auth).orderBy("day")


@query("SELECT value, cnt FROM (SELECT auth_type AS value, count(*) AS cnt FROM auth GROUP BY 1) ORDER BY cnt DESC, value LIMIT 3")
def topk(c):
    return A.marginals(c.auth, UNBOUNDED).where(F.col("column") == "auth_type").select("value", "cnt").orderBy(F.desc("cnt"), "value").limit(3)


BENIGN = f"drawn AS (SELECT {AUTH}, event_id FROM auth WHERE time BETWEEN {LO} AND {HI} ORDER BY {sql_u(SEED, 'benign', *EVENT_KEY, 'event_id')}, {K4}, event_id LIMIT 500)"


@query("SELECT event_id FROM drawn", extra=BENIGN)
def reservoir_sample(c):
    return sampling.choice(c.auth.where(between(c.auth, LO, HI)), 500, SEED, "benign", *sampling.KEY).select("event_id")


@query(f"SELECT event_id, {AUTH} FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM redteam r WHERE r.src_computer = d.src_computer AND r.dst_computer = d.dst_computer)", extra=BENIGN)
def benign_sample(c):
    return sampling.benign_sample(c.auth, LO, HI, 500, c.redteam, SEED).select("event_id", *AUTH_COLS)


@query(f"SELECT computer, \"user\" FROM (SELECT DISTINCT computer, \"user\" FROM uh) QUALIFY row_number() OVER (PARTITION BY computer ORDER BY {sql_u(SEED, 'pick', 'computer', '\"user\"')}, \"user\") <= 2", "uh")
def choice_wo_replacement(c):
    return first_k_per(c.user_host.select("computer", "user").distinct(), ["computer"], 2, u(SEED, "pick", "computer", "user"), "user").select("computer", "user")


@query(f"SELECT src_computer, dst_computer, row_number() OVER (ORDER BY race, src_computer, dst_computer) - 1 AS draw_rank FROM (SELECT *, {sql_race(SEED, 'edges', 'weight', 'src_computer', 'dst_computer')} AS race FROM edges) ORDER BY race, src_computer, dst_computer LIMIT 100", "edges")
def weighted_choice_wo_replacement(c):
    return sampling.weighted_choice(c.edges, 100, "weight", SEED, "edges", *PAIR).select(*PAIR, F.col("draw_rank").cast("long").alias("draw_rank"))


@query("SELECT attempt, foothold FROM feet", "synth")
def weighted_choice_with_replacement(c):
    return _feet(c).select("attempt", "foothold")


def _feet(c):
    return G.pick_footholds(G.attempts(c.spark, TRIES), G.foothold_candidates(c.nodes, CONFIG.min_foothold_out_degree), SEED)


@query(f"SELECT range AS draw, dt FROM range(200) d JOIN dts ON idx = floor({sql_u(SEED, 'boot', 'range')} * (SELECT count(*) FROM dts))::BIGINT", "synth")
def bootstrap(c):
    return sampling.bootstrap(c.spark.range(200).select(F.col("id").alias("draw")), c.dts, SEED, "boot", "draw").select("draw", "dt")


@query(f"SELECT event_id, label FROM scored WHERE label = 1 UNION ALL (SELECT event_id, label FROM scored WHERE label = 0 ORDER BY {sql_u(SEED, 'eval', 'event_id')}, event_id LIMIT (SELECT round_even(count(*) * 0.9::DOUBLE / 0.1::DOUBLE, 0)::BIGINT FROM scored WHERE label = 1))", "scored")
def downsample_eval(c):
    return sampling.downsample_eval(c.scored, 0.1, SEED, "event_id").select("event_id", "label")


@query(f"SELECT campaign_id FROM (SELECT DISTINCT campaign_id FROM split WHERE side = 'fit') ORDER BY {sql_u(SEED, 'campaigns', 'campaign_id')}, campaign_id LIMIT 4", "split")
def draw_campaigns(c):
    return sampling.draw_campaigns(c.fit_campaigns, 4, SEED)


# --- sets ------------------------------------------------------------------------------------------------------------


@query("SELECT src_user AS \"user\", src_computer AS computer FROM fit UNION ALL SELECT src_user, dst_computer FROM fit", "fit")
def union_all(c):
    fit = c.auth.where(FIT.condition(c.auth))
    return fit.select(F.col("src_user").alias("user"), F.col("src_computer").alias("computer")).unionByName(fit.select(F.col("src_user").alias("user"), F.col("dst_computer").alias("computer")))


@query(f"SELECT {AUTH}, 0 AS label FROM hard UNION ALL SELECT {AUTH}, 1 FROM matched", "matched", extra=HARD)
def stack(c):
    return sampling.stack_classes([c.matched], _hard(c).drop("side"))


@query("SELECT DISTINCT src_computer, dst_computer FROM redteam")
def distinct_edges(c):
    return c.redteam.select(*PAIR).distinct()


SETS = "s AS (SELECT DISTINCT src_computer, dst_computer FROM synth_rows), f AS (SELECT DISTINCT src_computer, dst_computer FROM split WHERE side = 'fit')"


@query("SELECT 'difference' AS what, * FROM (SELECT * FROM s EXCEPT SELECT * FROM f) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM s INTERSECT SELECT * FROM f) UNION ALL SELECT 'union', * FROM (SELECT * FROM s UNION SELECT * FROM f)", "synth_rows", extra=SETS)
def set_algebra(c):
    s, f = c.synth_rows.select(*PAIR).distinct(), c.fit_campaigns.select(*PAIR).distinct()
    parts = {"difference": s.subtract(f), "intersection": s.intersect(f), "union": s.union(f).distinct()}
    out = [df.select(F.lit(k).alias("what"), *PAIR) for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT DISTINCT campaign_id, src_computer, dst_computer FROM camp", "camp")
def edge_sets(c):
    return validate.edge_sets(c.campaigns)


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT event_id, (time // 3600) % 24 AS hour, time // 86400 AS day, round(ln(time + 1), 6) AS ln_t, round(log10(1 + time), 6) AS log_t, round(sqrt(time), 6) AS root, round(pow((time % 10)::DOUBLE, 1.5), 6) AS power, round_even((time % 100) / 8.0::DOUBLE, 0)::BIGINT AS half_even, least(floor((time - 0) / 2592000.0::DOUBLE * 20), 19)::BIGINT AS bin, concat_ws('|', auth_type, success) AS k, coalesce(nullif(auth_type, '?'), 'unknown') AS known FROM auth")
def scalar_functions(c):
    t = F.col("time")
    return c.auth.select(
        "event_id", F.expr("(time div 3600) % 24").alias("hour"), F.expr("time div 86400").alias("day"), F.round(F.ln(t + 1), 6).alias("ln_t"), F.round(F.log10(1 + t), 6).alias("log_t"), F.round(F.sqrt(t), 6).alias("root"),
        F.round(F.pow((t % 10).cast("double"), F.lit(1.5)), 6).alias("power"), F.bround((t % 100) / F.lit(8.0)).cast("long").alias("half_even"), metrics.bin_of(t, F.lit(0.0), F.lit(2592000.0), 20).alias("bin"),
        F.concat_ws("|", "auth_type", "success").alias("k"), F.coalesce(F.nullif("auth_type", F.lit("?")), F.lit("unknown")).alias("known"),
    )


# --- features --------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, label, {s6('edge_rarity')} FROM scored", "scored")
def edge_rarity(c):
    return c.scored.select("event_id", "label", *r6("edge_rarity"))


@query(f"SELECT event_id, {s6('edge_rarity')}, dst_in_degree, src_out_degree, n_hosts_for_cred FROM structural", "scored", "nodes", "uh", extra=FEATURES)
def structural_features(c):
    return P.structural(c.labelled, c.edges, c.nodes, c.user_host).select("event_id", *r6("edge_rarity"), *P.STRUCTURAL[1:])


def _hot(column: str, vocabulary: list[str], prefix: str) -> str:
    rest = ", ".join(f"'{v}'" for v in vocabulary if v not in ("unknown", "other"))
    value = f"CASE WHEN {column} IN ('?', 'unknown') THEN 'unknown' WHEN {column} IN ({rest}) THEN {column} ELSE 'other' END"
    return ", ".join(f"(({value}) = '{v}')::INT::DOUBLE AS {prefix}_{v}" for v in vocabulary)


HOT = f"{_hot('auth_type', P.AUTH_TYPES, 'auth')}, {_hot('logon_type', P.LOGON_TYPES, 'logon')}"


@query(f"SELECT event_id, {HOT} FROM auth")
def attribute_features(c):
    return P.attributes(c.auth).select("event_id", *P.ATTRIBUTE)


@query(f"SELECT event_id, {s6('edge_rarity')}, dst_in_degree, src_out_degree, n_hosts_for_cred, {HOT} FROM structural", "scored", "nodes", "uh", extra=FEATURES)
def build_features(c):
    out = P.build_features(c.labelled, c.edges, c.nodes, c.user_host, keep=("event_id",))
    return out.withColumn("edge_rarity", F.round("edge_rarity", 6))


@query('SELECT event_id, CASE WHEN u."user" IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS credential_novelty FROM auth a LEFT JOIN uh u ON u."user" = a.src_user AND u.computer = a.dst_computer', "uh")
def credential_novelty(c):
    return P.credential_novelty(c.auth, c.user_host).select("event_id", "credential_novelty")


@query("SELECT event_id, (src_computer = dst_computer)::INT::DOUBLE AS is_self_auth, (src_user LIKE '%$@%')::INT::DOUBLE AS is_machine_account FROM auth")
def candidate_features(c):
    return P.candidate_features(c.auth).select("event_id", "is_self_auth", "is_machine_account")


# --- generator -------------------------------------------------------------------------------------------------------


@query("SELECT host, out_degree FROM nodes WHERE out_degree >= 25", "nodes")
def foothold_candidates(c):
    return G.foothold_candidates(c.nodes, CONFIG.min_foothold_out_degree)


@query("SELECT attempt, foothold, out_degree FROM feet", "synth")
def pick_foothold(c):
    return _feet(c)


def _creds(c):
    return G.harvest(_feet(c), c.user_host, CONFIG.max_harvested_creds, SEED)


@query('SELECT attempt, "user" FROM creds', "synth")
def harvest_credentials(c):
    return _creds(c)


@query('SELECT attempt, "user" FROM used0', "synth")
def restrict_creds(c):
    return G.restrict(_creds(c), c.breadth, SEED)


@query("SELECT campaign_id, capped::INT AS capped, count(*) AS events FROM synth GROUP BY ALL", "synth")
def breadth_cap(c):
    return c.synth().groupBy("campaign_id", F.col("capped").cast("int").alias("capped")).agg(F.count("*").alias("events")).withColumn("campaign_id", F.col("campaign_id").cast("long"))


SYNTH_SQL = 'SELECT attempt, campaign_id, hop_index, dt_offset, "user", src_computer, dst_computer FROM synth'


def _synth(df):
    return df.select("attempt", F.col("campaign_id").cast("long").alias("campaign_id"), F.col("hop_index").cast("long").alias("hop_index"), "dt_offset", "user", "src_computer", "dst_computer")


@query(SYNTH_SQL, "synth")
def generate_campaigns(c):
    return _synth(c.synth())


@query(SYNTH_SQL, "synth", naive=True)
def naive_mode(c):
    return _synth(c.synth(naive=True))


@query(f"SELECT count(*) AS n, max(attempt) + 1 AS attempts, round((max(attempt) + 1 - count(*)) / (max(attempt) + 1), 6) AS discard_rate, round(avg(capped::INT::DOUBLE), 6) AS cap_rate FROM (SELECT DISTINCT campaign_id, attempt, capped FROM synth)", "synth")
def generate_corpus(c):
    return G.corpus_stats(c.synth()).select("n", "attempts", *r6("discard_rate", "cap_rate"))


@query("SELECT campaign_id, start FROM starts", "starts")
def sample_start_time(c):
    return c.starts.select(F.col("campaign_id").cast("long").alias("campaign_id"), "start")


@query("SELECT campaign_id, hop_index, start + dt_offset AS time FROM synth JOIN starts USING (campaign_id)", "starts")
def place_campaign(c):
    return G.place(c.synth(), c.starts).select(F.col("campaign_id").cast("long").alias("campaign_id"), F.col("hop_index").cast("long").alias("hop_index"), "time")


@query(f"SELECT {AUTH}, row_id, campaign_id, hop_index FROM synth_rows", "synth_rows")
def synth_rows(c):
    return c.synth_rows.select(*AUTH_COLS, "row_id", F.col("campaign_id").cast("long").alias("campaign_id"), F.col("hop_index").cast("long").alias("hop_index"))


@query(f"SELECT side, label, count(*) AS n FROM (SELECT side, 1 AS label FROM split UNION ALL SELECT side, 0 FROM hard UNION ALL SELECT CASE WHEN time <= {T} THEN 'fit' ELSE 'holdout' END, 0 FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM redteam r WHERE r.src_computer = d.src_computer AND r.dst_computer = d.dst_computer)) GROUP BY ALL", "split", extra=HARD + ", " + BENIGN)
def splits(c):
    benign = sampling.benign_sample(c.auth, LO, HI, 500, c.redteam, SEED).select(F.when(F.col("time") <= T, "fit").otherwise("holdout").alias("side"), F.lit(0).alias("label"))
    rows = c.split.select("side", F.lit(1).alias("label")).unionByName(_hard(c).select("side", F.lit(0).alias("label"))).unionByName(benign)
    return rows.groupBy("side", "label").agg(F.count("*").alias("n"))


# --- metrics, validation, leaks --------------------------------------------------------------------------------------


@query("SELECT event_id, round((SELECT count(*) FROM labelled) / (2 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM labelled", "labelled")
def balanced_weights(c):
    return metrics.balanced_weights(c.labelled).select("event_id", *r6("weight"))


AP = """grp AS (SELECT edge_rarity AS score, sum(label)::BIGINT AS tp, count(*) AS n FROM scored GROUP BY 1),
cum AS (SELECT score, tp, n, sum(tp) OVER (ORDER BY score DESC)::BIGINT AS ct, sum(n) OVER (ORDER BY score DESC)::BIGINT AS cn, (SELECT sum(tp) FROM grp)::BIGINT AS p FROM grp)"""


@query("SELECT round(sum(tp * ct / cn) / max(p), 6) AS average_precision, max(p) AS positives, sum(n)::BIGINT AS rows FROM cum", "scored", extra=AP)
def rarity_baseline(c):
    return metrics.average_precision(c.scored, "edge_rarity").select(*r6("average_precision"), "positives", "rows")


@query("SELECT round(score, 6) AS threshold, round(ct / cn, 6) AS precision, round(ct / p, 6) AS recall FROM cum UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE", "scored", extra=AP)
def pr_curve(c):
    return metrics.pr_curve(c.scored, "edge_rarity").select(*r6("threshold", "precision", "recall"))


CELLS = "cells AS (SELECT label AS k, event_id % 7 AS seed, avg(edge_rarity) AS a, avg(edge_rarity) FILTER (event_id % 2 = 0) AS b FROM scored GROUP BY 1, 2)"


def _cells(c):
    return c.scored.groupBy(F.col("label").alias("k"), (F.col("event_id") % 7).alias("seed")).agg(F.avg("edge_rarity").alias("a"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("edge_rarity"))).alias("b"))


@query("SELECT k, count(a) AS n, round(avg(a), 6) AS mean, round(CASE WHEN count(a) >= 2 THEN 1.96 * stddev_samp(a) / sqrt(count(a)) ELSE 0 END, 6) AS ci FROM cells GROUP BY 1", "scored", extra=CELLS)
def mean_ci(c):
    return metrics.mean_ci(_cells(c), "a", "k").select("k", "n", *r6("mean", "ci"))


@query("SELECT k, count(b - a) AS n, round(avg(b - a), 6) AS mean_lift, round(stddev_samp(b - a), 6) AS sd_lift, sum((b > a)::INT)::BIGINT AS wins, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(b - a))), 4) AS t FROM cells GROUP BY 1", "scored", extra=CELLS)
def paired_test(c):
    return metrics.paired_test(_cells(c), "a", "b", "k").select("k", "n", *r6("mean_lift", "sd_lift"), "wins", F.round("t", 4).alias("t"))


JACCARD = """s AS (SELECT DISTINCT campaign_id, src_computer, dst_computer FROM synth_rows), f AS (SELECT DISTINCT campaign_id AS fit_id, src_computer, dst_computer FROM split WHERE side = 'fit'),
cc AS (SELECT s.campaign_id, fit_id, count(*) AS n FROM s JOIN f USING (src_computer, dst_computer) GROUP BY 1, 2),
jac AS (SELECT a.campaign_id, coalesce(max(n / (a.n_a + b.n_b - n)), 0.0::DOUBLE) AS max_jaccard FROM (SELECT campaign_id, count(*) AS n_a FROM s GROUP BY 1) a LEFT JOIN cc USING (campaign_id) LEFT JOIN (SELECT fit_id, count(*) AS n_b FROM f GROUP BY 1) b USING (fit_id) GROUP BY 1)"""


@query(f"SELECT campaign_id, {s6('max_jaccard')} FROM jac", "synth_rows", extra=JACCARD)
def max_jaccard(c):
    return validate.max_jaccard(c.synth_rows, c.fit_campaigns).select(F.col("campaign_id").cast("long").alias("campaign_id"), *r6("max_jaccard"))


@query("SELECT round(avg((max_jaccard >= 0.5)::INT::DOUBLE), 6) AS pct_near_duplicate, count(*) AS n_campaigns, (SELECT count(*) FROM (SELECT DISTINCT src_computer, dst_computer FROM s)) AS n_synth_edges, round((SELECT count(*) FROM (SELECT src_computer, dst_computer FROM s EXCEPT SELECT src_computer, dst_computer FROM f)) / (SELECT count(*) FROM (SELECT DISTINCT src_computer, dst_computer FROM s)), 6) AS edge_novelty_rate, (SELECT count(*) FROM (SELECT DISTINCT src_computer, dst_computer FROM f)) AS n_fit_edges FROM jac", "synth_rows", extra=JACCARD)
def novelty_summary(c):
    out = validate.novelty_summary(c.synth_rows, c.fit_campaigns)
    return out.select(*r6("pct_near_duplicate"), "n_campaigns", "n_synth_edges", *r6("edge_novelty_rate"), "n_fit_edges")


@query("SELECT round(quantile_cont(max_jaccard, 0.5), 6) AS p50, round(quantile_cont(max_jaccard, 0.95), 6) AS p95, round(quantile_cont(max_jaccard, 0.99), 6) AS p99, count(*) FILTER (max_jaccard = 0) AS n_zero FROM jac", "synth_rows", extra=JACCARD)
def jaccard_quantiles(c):
    return validate.jaccard_quantiles(c.synth_rows, c.fit_campaigns).select(*r6("p50", "p95", "p99"), "n_zero")


V1 = """dd AS (SELECT time - lag(time) OVER (PARTITION BY campaign_id ORDER BY hop_index) AS dt FROM synth_rows), sp AS (SELECT min(time) AS lo, max(time) AS hi FROM synth_rows GROUP BY campaign_id),
chk AS (SELECT 'timestamps_strictly_increasing' AS "check", count(*) FILTER (dt <= 0) AS violations, min(dt) AS extreme FROM dd
  UNION ALL SELECT 'within_collection_window', count(*) FILTER (lo < 0 OR hi > 2592000), max(hi) FROM sp
  UNION ALL SELECT 'edges_exist_in_graph', count(*), NULL FROM synth_rows r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src_computer = r.src_computer AND e.dst_computer = r.dst_computer))"""


@query("SELECT \"check\", CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status, violations, extreme FROM chk UNION ALL SELECT 'no_credential_used_before_acquisition', 'n/a', NULL, NULL", "synth_rows", extra=V1)
def v1_report(c):
    return validate.v1_checks(c.synth_rows, c.edges, CONFIG.collection_seconds)


def _sides(c, what):
    return validate.two_sided(c.synth_rows, c.fit_campaigns, what, c.nodes)


SIDED = """per AS (SELECT 0 AS side, campaign_id, count(DISTINCT dst_computer) AS breadth, count(DISTINCT src_user) AS creds FROM synth_rows GROUP BY 2 UNION ALL SELECT 1, campaign_id, count(DISTINCT dst_computer), count(DISTINCT src_user) FROM split WHERE side = 'fit' GROUP BY 2),
dtv AS (SELECT * FROM (SELECT 0 AS side, time - lag(time) OVER (PARTITION BY campaign_id ORDER BY time) AS dt FROM synth_rows UNION ALL SELECT 1, time - lag(time) OVER (PARTITION BY campaign_id ORDER BY time) FROM split WHERE side = 'fit') WHERE dt > 0),
vals AS (SELECT 'breadth' AS what, side, breadth::DOUBLE AS v FROM per UNION ALL SELECT 'creds', side, creds::DOUBLE FROM per UNION ALL SELECT 'dt', side, dt::DOUBLE FROM dtv),
cdf AS (SELECT what, v, sum(count(*) FILTER (side = 0)) OVER (PARTITION BY what ORDER BY v) AS ca, sum(count(*) FILTER (side = 1)) OVER (PARTITION BY what ORDER BY v) AS cb FROM vals GROUP BY what, v),
deg_v AS (SELECT 0 AS side, log10(1 + coalesce(in_degree, 0)) AS v FROM synth_rows LEFT JOIN nodes ON host = dst_computer UNION ALL SELECT 1, log10(1 + coalesce(in_degree, 0)) FROM split LEFT JOIN nodes ON host = dst_computer WHERE side = 'fit'),
lim AS (SELECT min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) ELSE min(v) + 1 END AS hi FROM deg_v),
bins AS (SELECT least(floor((v - lo) / (hi - lo) * 20), 19) AS b, count(*) FILTER (side = 0)::DOUBLE AS a, count(*) FILTER (side = 1)::DOUBLE AS z FROM deg_v, lim GROUP BY 1),
pq AS (SELECT a / (SELECT sum(a) FROM bins) AS p, z / (SELECT sum(z) FROM bins) AS q FROM bins)"""


@query("SELECT what, round(max(abs(ca / (SELECT count(*) FROM vals x WHERE x.what = cdf.what AND side = 0) - cb / (SELECT count(*) FROM vals x WHERE x.what = cdf.what AND side = 1))), 6) AS ks FROM cdf GROUP BY what", "synth_rows", extra=SIDED)
def ks_2samp(c):
    out = [metrics.ks_statistic(_sides(c, w)).select(F.lit(w).alias("what"), *r6("ks")) for w in ("breadth", "creds", "dt")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM pq", "synth_rows", extra=SIDED)
def js_divergence(c):
    return metrics.js_divergence(_sides(c, "in_degree")).select(*r6("js"))


@query("SELECT side, bin, n, round(n / (sum(n) OVER (PARTITION BY side) * (hi - lo) / 25), 6) AS density FROM (SELECT side, least(floor((v - lo) / (hi - lo) * 25), 24)::BIGINT AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM vals, (SELECT min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) ELSE min(v) + 1 END AS hi FROM vals WHERE what = 'breadth') WHERE what = 'breadth' GROUP BY 1, 2)", "synth_rows", extra=SIDED)
def overlay_histograms(c):
    return metrics.overlay_histogram(_sides(c, "breadth")).select("side", "bin", "n", *r6("density"))


@query("SELECT what, side, count(*) AS n, round(median(v), 6) AS med, round(avg(v), 6) AS mean FROM vals GROUP BY ALL", "synth_rows", extra=SIDED)
def v2_report(c):
    out = None
    for w in ("breadth", "creds", "dt"):
        part = _sides(c, w).groupBy(F.lit(w).alias("what"), "side").agg(F.count("*").alias("n"), F.round(F.expr("percentile(CAST(value AS DOUBLE), 0.5)"), 6).alias("med"), F.round(F.avg("value"), 6).alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT label, count(*) AS n, count(*) FILTER (weight IS NULL) AS n_unseen, round(avg((weight IS NULL)::INT::DOUBLE), 6) AS rate FROM labelled LEFT JOIN edges USING (src_computer, dst_computer) GROUP BY 1", "labelled", "edges")
def unseen_edge_rate(c):
    return validate.unseen_edge_rate(c.labelled, c.edges, "label").select("label", "n", "n_unseen", *r6("rate"))


@query("SELECT round(max(t), 6) AS threshold, count(*) FILTER (edge_rarity >= t) AS n_at, round(avg((edge_rarity >= t)::INT::DOUBLE), 6) AS share FROM scored, (SELECT quantile_cont(edge_rarity, 0.05) AS t FROM scored WHERE label = 1) WHERE label = 0", "scored")
def benign_at_rt_p5(c):
    return validate.benign_at_rarity(c.scored).select(*r6("threshold"), "n_at", *r6("share"))


@query("SELECT sum(weight)::BIGINT AS weight, (SELECT count(*) FROM fit) AS events, (sum(weight) = (SELECT count(*) FROM fit))::INT AS ok FROM edges", "edges")
def provenance_assert(c):
    return validate.provenance(c.edges, c.auth.where(FIT.condition(c.auth))).withColumn("ok", F.col("ok").cast("int"))


@query(None)
def gbt_detector(c):
    """Scores of a boosted model; MLlib's trees have no DuckDB twin."""
    from hostweave.operators.model import train_and_eval

    rows = P.build_features(c.labelled, c.edges, c.nodes, c.user_host, keep=("event_id", "label"))
    fitted = train_and_eval(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), P.STRUCTURAL + P.ATTRIBUTE, seed=SEED)
    return fitted.scored.select("event_id", "label", "score")


@query(None)
def logistic_detector(c):
    from hostweave.operators.model import train_and_eval

    rows = P.build_features(c.labelled, c.edges, c.nodes, c.user_host, keep=("event_id", "label"))
    fitted = train_and_eval(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), P.STRUCTURAL + P.ATTRIBUTE, model="logistic")
    return fitted.scored.select("event_id", "label", "score")

