"""Frames that many queries share, and their DuckDB twins."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions.hashrng import sql_race, sql_u
from hostweave.operators import aggregates, features, generate, graph, profile, redteam
from hostweave.schema import EVENT_KEY, FitWindow, between
from hostweave.sources import logs
from hostweave.sources.shared import cut

CONFIG = logs.Config()
FIT = FitWindow(CONFIG.t_hi)
SEED, CAMPAIGNS = 7, CONFIG.n_campaigns
TRIES = generate.MAX_ATTEMPTS * CAMPAIGNS


def kept(df: DataFrame) -> DataFrame:
    """Kept in memory or on disk for the plans that use it more than once; lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Context:
    """Lazily built frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._synth: dict[bool, DataFrame] = {}

    @cached_property
    def auth(self) -> DataFrame:
        return logs.auth(self.spark, self.sf_dir)

    @cached_property
    def redteam(self) -> DataFrame:
        return logs.auth_as_redteam(self.auth)

    @cached_property
    def edges(self) -> DataFrame:
        return kept(aggregates.edge_counts(self.auth, FIT))

    @cached_property
    def nodes(self) -> DataFrame:
        return kept(graph.with_servers(graph.node_degrees(self.edges), CONFIG.server_in_degree_percentile, CONFIG.server_min_in_out_ratio))

    @cached_property
    def user_host(self) -> DataFrame:
        return kept(aggregates.user_host_counts(self.auth, FIT))

    @cached_property
    def matched(self) -> DataFrame:
        return kept(redteam.recover_redteam(self.auth, self.redteam))

    @cached_property
    def campaigns(self) -> DataFrame:
        return kept(redteam.hop_index(redteam.sessionize(self.matched, CONFIG.campaign_gap_seconds)))

    @cached_property
    def split(self) -> DataFrame:
        return cut(redteam.freeze_split(self.campaigns, CONFIG.fit_fraction), "split")

    @cached_property
    def fit_campaigns(self) -> DataFrame:
        return self.split.where("side = 'fit'")

    @cached_property
    def labelled(self) -> DataFrame:
        """Log rows after the fit window with label 1 for labelled events."""
        keys = redteam.few(redteam.event_keys(self.redteam).withColumn("_k", F.lit(1)))
        rows = self.auth.where(between(self.auth, CONFIG.t_hi + 1, None)).join(keys, EVENT_KEY, "left")
        return kept(rows.withColumn("label", F.coalesce("_k", F.lit(0))).drop("_k"))

    @cached_property
    def scored(self) -> DataFrame:
        return kept(features.edge_rarity(self.labelled, self.edges))

    @cached_property
    def breadth(self) -> DataFrame:
        return kept(profile.breadth_and_creds(self.fit_campaigns))

    @cached_property
    def dts(self) -> DataFrame:
        return kept(profile.inter_event_dt(self.fit_campaigns))

    def synth(self, naive: bool = False) -> DataFrame:
        if naive not in self._synth:
            self._synth[naive] = cut(self._generate(naive), "campaigns")
        return self._synth[naive]

    def _generate(self, naive: bool) -> DataFrame:
        return generate.generate(
            self.edges, self.nodes, self.user_host, self.breadth, self.dts, CAMPAIGNS, alpha=CONFIG.alpha, beta=CONFIG.beta, credential_bonus=CONFIG.credential_bonus,
            min_out_degree=CONFIG.min_foothold_out_degree, max_creds=CONFIG.max_harvested_creds, seed=SEED, naive=naive, tries=TRIES,
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return kept(aggregates.hourly_volume(self.auth, FIT))

    @cached_property
    def starts(self) -> DataFrame:
        return generate.start_times(self.synth(), self.hourly, CONFIG.collection_seconds, SEED)

    @cached_property
    def synth_rows(self) -> DataFrame:
        return kept(generate.as_rows(generate.place(self.synth(), self.starts)))


T = CONFIG.t_hi
K4 = "time, src_user, src_computer, dst_computer"


def _synth_sql(naive: bool) -> str:
    m_rule = "SELECT attempt, \"user\" FROM creds" if naive else (
        f"SELECT attempt, \"user\" FROM (SELECT c.attempt, c.\"user\", m.m, row_number() OVER (PARTITION BY c.attempt ORDER BY {sql_u(SEED, 'restrict', 'c.attempt', 'c.\"user\"')}, c.\"user\") AS r FROM creds c JOIN mm m USING (attempt)) WHERE r <= m OR m <= 0"
    )
    w = "1.0::DOUBLE" if naive else "te.weight::DOUBLE * (te.in_degree + 1.0::DOUBLE) * CASE WHEN kt.attempt IS NOT NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    pool = "e.pool" if naive else "coalesce(p.best, e.pool)"
    return f"""pool AS (SELECT host, out_degree, sum(out_degree::DOUBLE) OVER (ORDER BY host) AS hi FROM nodes WHERE out_degree >= 25),
tries AS (SELECT range AS attempt, {sql_u(SEED, 'foothold', 'range')} * (SELECT max(hi) FROM pool) AS r FROM range({TRIES})),
feet AS (SELECT attempt, host AS foothold, out_degree FROM tries JOIN pool ON r >= hi - out_degree AND r < hi),
creds AS (SELECT attempt, "user" FROM (SELECT f.attempt, x."user", row_number() OVER (PARTITION BY f.attempt ORDER BY {sql_u(SEED, 'harvest', 'f.attempt', 'x."user"')}, x."user") AS r
  FROM feet f JOIN (SELECT DISTINCT "user", computer FROM uh) x ON x.computer = f.foothold) WHERE r <= {CONFIG.max_harvested_creds}),
lists AS (SELECT row_number() OVER (ORDER BY campaign_id) - 1 AS idx, breadth, creds FROM (SELECT campaign_id, count(DISTINCT dst_computer) AS breadth, count(DISTINCT src_user) AS creds FROM split WHERE side = 'fit' GROUP BY 1)),
mm AS (SELECT t.attempt, l.creds AS m FROM (SELECT DISTINCT attempt FROM creds) t JOIN lists l ON l.idx = floor({sql_u(SEED, 'creds', 't.attempt')} * (SELECT count(*) FROM lists))::BIGINT),
used0 AS ({m_rule}),
valid AS (SELECT attempt, row_number() OVER (ORDER BY attempt) - 1 AS campaign_id FROM (SELECT DISTINCT attempt FROM used0) QUALIFY campaign_id < {CAMPAIGNS}),
used AS (SELECT u.attempt, u."user" FROM used0 u JOIN valid USING (attempt)),
sizes AS (SELECT f.attempt, f.foothold, v.campaign_id, l.breadth > f.out_degree AS capped, least(l.breadth, f.out_degree) AS k FROM feet f JOIN valid v USING (attempt)
  JOIN lists l ON l.idx = floor({sql_u(SEED, 'breadth', 'f.attempt')} * (SELECT count(*) FROM lists))::BIGINT),
known AS (SELECT DISTINCT u.attempt, x.computer AS dst_computer, u."user" FROM used u JOIN uh x ON x."user" = u."user"),
te AS (SELECT s.*, e.dst_computer, e.weight, n.in_degree FROM sizes s JOIN edges e ON e.src_computer = s.foothold JOIN nodes n ON n.host = e.dst_computer),
ranked AS (SELECT te.*, row_number() OVER (PARTITION BY te.attempt ORDER BY {sql_race(SEED, 'target', w, 'te.attempt', 'te.dst_computer')}, te.dst_computer) - 1 AS hop_index
  FROM te LEFT JOIN (SELECT DISTINCT attempt, dst_computer FROM known) kt ON kt.attempt = te.attempt AND kt.dst_computer = te.dst_computer),
g AS (SELECT campaign_id, time - lag(time) OVER (PARTITION BY campaign_id ORDER BY time) AS dt, time FROM split WHERE side = 'fit'),
g1 AS (SELECT campaign_id, time, dt FROM g WHERE dt > 0 UNION ALL SELECT -1, 0, 1 WHERE NOT EXISTS (SELECT 1 FROM g WHERE dt > 0)),
dts AS (SELECT dt, row_number() OVER (ORDER BY campaign_id, time, dt) - 1 AS idx FROM g1),
chosen AS (SELECT r.*, d.dt FROM ranked r JOIN dts d ON d.idx = floor({sql_u(SEED, 'dt', 'r.attempt', 'r.hop_index')} * (SELECT count(*) FROM dts))::BIGINT WHERE r.hop_index < r.k),
everyone AS (SELECT attempt, list(DISTINCT "user" ORDER BY "user") AS pool FROM used GROUP BY 1),
preferred AS (SELECT attempt, dst_computer, list(DISTINCT "user" ORDER BY "user") AS best FROM known GROUP BY 1, 2),
synth AS (SELECT c.attempt, c.campaign_id, c.hop_index, sum(c.dt) OVER (PARTITION BY c.attempt ORDER BY c.hop_index)::BIGINT AS dt_offset,
  ({pool})[floor({sql_u(SEED, 'user', 'c.attempt', 'c.dst_computer')} * len({pool}))::BIGINT + 1] AS "user", c.foothold AS src_computer, c.dst_computer, c.capped
  FROM chosen c JOIN everyone e ON e.attempt = c.attempt LEFT JOIN preferred p ON p.attempt = c.attempt AND p.dst_computer = c.dst_computer)"""


#: Named DuckDB tables in the order that they build on each other.
CTES = {
    "fit": f"fit AS (SELECT * FROM auth WHERE time <= {T})",
    "edges": "edges AS (SELECT src_computer, dst_computer, count(*) AS weight FROM fit GROUP BY ALL)",
    "nodes": """deg AS (SELECT host, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT dst_computer AS host, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src_computer, 0, 1 FROM edges) GROUP BY host),
nodes AS (SELECT *, in_degree / (out_degree + 1) AS in_out_ratio, in_degree >= (SELECT quantile_cont(in_degree::DOUBLE, 0.95) FROM deg) AND in_degree / (out_degree + 1) >= 1.0 AS is_server FROM deg)""",
    "uh": 'uh AS (SELECT "user", computer, count(*) AS cnt FROM (SELECT src_user AS "user", src_computer AS computer FROM fit UNION ALL SELECT src_user, dst_computer FROM fit) GROUP BY ALL)',
    "keys": 'keys AS (SELECT DISTINCT time, "user" AS src_user, src_computer, dst_computer FROM redteam)',
    "matched": f"""matched AS (SELECT * EXCLUDE (rn) FROM (SELECT a.* EXCLUDE (event_id), row_number() OVER (PARTITION BY {K4} ORDER BY dst_user, auth_type, logon_type, auth_orientation, success) AS rn FROM auth a JOIN keys USING ({K4})) WHERE rn = 1)""",
    "camp": f"""sess AS (SELECT *, CASE WHEN time - lag(time) OVER (ORDER BY {K4}) > 14400 THEN 1 ELSE 0 END AS new FROM matched),
sess2 AS (SELECT * EXCLUDE (new), sum(new) OVER (ORDER BY {K4})::BIGINT AS campaign_id FROM sess),
camp AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY {K4}) - 1 AS hop_index FROM sess2)""",
    "split": """spans AS (SELECT campaign_id, min(time) AS lo, max(time) AS hi FROM camp GROUP BY 1),
gaps AS (SELECT campaign_id, row_number() OVER (ORDER BY lo, campaign_id) AS k, hi, lead(lo) OVER (ORDER BY lo, campaign_id) AS nxt,
  (SELECT min(lo) FROM spans) + 0.7::DOUBLE * ((SELECT hi FROM spans ORDER BY lo DESC, campaign_id DESC LIMIT 1) - (SELECT min(lo) FROM spans)) AS cut FROM spans),
best AS (SELECT k FROM gaps WHERE nxt IS NOT NULL ORDER BY greatest(hi - cut, cut - nxt, 0.0), k LIMIT 1),
sides AS (SELECT campaign_id, CASE WHEN NOT EXISTS (SELECT 1 FROM best) OR k <= (SELECT k FROM best) THEN 'fit' ELSE 'holdout' END AS side FROM gaps),
split AS (SELECT camp.*, side FROM camp JOIN sides USING (campaign_id))""",
    "labelled": f"labelled AS (SELECT a.*, CASE WHEN k.time IS NULL THEN 0 ELSE 1 END AS label FROM auth a LEFT JOIN keys k USING ({K4}) WHERE a.time > {T})",
    "scored": "scored AS (SELECT l.*, ln((SELECT sum(weight)::DOUBLE FROM edges) / coalesce(e.weight::DOUBLE, 0.5::DOUBLE)) AS edge_rarity FROM labelled l LEFT JOIN edges e USING (src_computer, dst_computer))",
    "synth": _synth_sql(False),
    "hourly": "hourly AS (SELECT (time // 3600) % 24 AS hour, count(*) AS cnt FROM fit GROUP BY 1)",
    "starts": f"""room AS (SELECT campaign_id, 2592000 - max(dt_offset) AS room FROM synth GROUP BY 1),
hs AS (SELECT campaign_id, room, hour, cnt, greatest(least(room - hour * 3600 + 1, 3600), 0)::BIGINT AS seconds FROM room, hourly),
hh AS (SELECT *, sum(cnt * seconds) OVER (PARTITION BY campaign_id ORDER BY hour)::BIGINT AS hi, sum(cnt * seconds) OVER (PARTITION BY campaign_id)::BIGINT AS total FROM hs),
starts AS (SELECT campaign_id, (floor({sql_u(SEED, 'day', 'campaign_id')} * greatest(room // 86400, 1)) * 86400 + hour * 3600 + floor({sql_u(SEED, 'second', 'campaign_id')} * seconds))::BIGINT AS start
  FROM hh WHERE {sql_u(SEED, 'hour', 'campaign_id')} * total::DOUBLE >= (hi - cnt * seconds)::DOUBLE AND {sql_u(SEED, 'hour', 'campaign_id')} * total::DOUBLE < hi::DOUBLE)""",
    "synth_rows": """cb AS (SELECT campaign_id, (sum(n) OVER (ORDER BY campaign_id) - n)::BIGINT AS before FROM (SELECT campaign_id, count(*) AS n FROM synth GROUP BY 1)),
synth_rows AS (SELECT start + dt_offset AS time, "user" AS src_user, "user" AS dst_user, src_computer, dst_computer, 'NTLM' AS auth_type, 'Network' AS logon_type, 'LogOn' AS auth_orientation, 'Success' AS success,
  before + hop_index AS row_id, 1 AS is_malicious, campaign_id, hop_index FROM synth JOIN starts USING (campaign_id) JOIN cb USING (campaign_id))""",
}
NEEDS = {
    "edges": ["fit"], "nodes": ["edges"], "uh": ["fit"], "matched": ["keys"], "camp": ["matched"], "split": ["camp"], "labelled": ["keys"], "scored": ["labelled", "edges"],
    "synth": ["nodes", "uh", "split"], "hourly": ["fit"], "starts": ["synth", "hourly"], "synth_rows": ["starts"],
}


def with_tables(final: str, *names: str, extra: str = "", naive: bool = False) -> str:
    """final with the named tables before it; extra holds further tables of the query's own."""
    wanted: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += NEEDS.get(n, [])
    parts = [logs.SQL_AUTH, logs.SQL_REDTEAM, *[_synth_sql(naive) if n == "synth" else CTES[n] for n in CTES if n in wanted], *([extra] if extra else [])]
    return f"WITH {', '.join(parts)} {final}"
