"""Scans and sinks of authentication logs, and the adapter from an events table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave import schema
from hostweave.schema import AUTH_COLS, AUTH_SCHEMA, DAY, LABEL_COLS, REDTEAM_SCHEMA
from hostweave.sources.shared import read_text, write_text

EPOCH = f"timestamp_ntz'{schema.EPOCH}'"


def session(app: str = "hostweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; memory, spill folder and parallelism come from conf."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scan_auth(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV (plain or gzip) with nine declared columns; a malformed row fails the read. A missing field is null, `?` stays a value."""
    return spark.read.schema(AUTH_SCHEMA).option("header", False).option("mode", "FAILFAST").csv(path)


def scan_redteam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REDTEAM_SCHEMA).option("header", False).option("mode", "FAILFAST").csv(path)


def scan_derived(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with inferred types; derived tables of this engine are Parquet instead."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def ingest(auth: DataFrame, path: str, files_per_day: int = 1) -> None:
    """One pass from CSV to Parquet by day, sorted by time within files, so that time bounds prune folders and row groups.

    A gzip file is read by one task; the range partitioning spreads it before anything else is computed.
    """
    days = auth.withColumn("day", F.expr(f"CAST(time div {DAY} AS INT)"))
    days = days.repartitionByRange("day", "time") if files_per_day == 1 else days.repartitionByRange("day", F.xxhash64("time"))
    days.sortWithinPartitions("day", "time").write.mode("errorifexists").partitionBy("day").parquet(path)


def write_auth_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Headerless, in the log's column order; single writes one file ordered by time."""
    out = rows.select(*AUTH_COLS)
    (out.orderBy("time").coalesce(1) if single else out).write.mode("errorifexists").option("header", False).csv(path)


def write_labels_csv(labels: DataFrame, path: str) -> None:
    labels.select(*LABEL_COLS).write.mode("errorifexists").option("header", True).csv(path)


def save(df: DataFrame, root: str, name: str, arm: str | None = None) -> None:
    """Frozen Parquet: an existing table is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{root}/{name}" + (f"/arm={arm}" if arm else ""))


def load(spark: SparkSession, root: str, name: str, arm: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}" + (f"/arm={arm}" if arm else ""))


def save_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    """A small report, whole or not at all, on any file system that the session knows."""
    write_text(spark or SparkSession.active(), path, json.dumps(value, indent=2, sort_keys=True, default=str))


def load_json(spark: SparkSession, path: str) -> object | None:
    """What save_json wrote, None where there is no file."""
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


@dataclass
class Config:
    """All knobs, with the defaults of the experiments; from_yaml overrides those that a file names."""

    seed: int = 42
    campaign_gap_seconds: int = 14400
    fit_fraction: float = 0.70
    server_in_degree_percentile: float = 95
    server_min_in_out_ratio: float = 1.0
    target_keep_ratio: float = 1.5
    alpha: float = 1.0
    beta: float = 1.0
    credential_bonus: float = 2.0
    min_foothold_out_degree: int = 25
    max_harvested_creds: int = 60
    n_campaigns: int = 10_000
    campaigns_per_point: int = 1000
    t_hi: int = 21 * DAY
    collection_seconds: int = 30 * DAY
    base_rates: list[float] = field(default_factory=lambda: [0.01, 0.001])
    k_values: list[int] = field(default_factory=lambda: [1, 2, 4, 8, 13])
    n_seeds: int = 5
    gbt: dict = field(default_factory=lambda: {"maxDepth": 3, "maxIter": 100, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 5})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            given = yaml.safe_load(f) or {}
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)


def events_as_auth(events: DataFrame) -> DataFrame:
    """An authentication log derived from an events table, with event_id, and ts so that bounds on time reach the scan."""
    k = F.regexp_extract("props", '"k": ?([0-9]+)', 1).cast("int")
    user = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@D1"))
    pick = lambda c, values, other: F.when(F.lit(False), F.lit("")).otherwise(F.lit(other)) if not values else _case(c, values, other)
    return events.select(
        "event_id",
        F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("time"),
        user.alias("src_user"),
        user.alias("dst_user"),
        F.concat(F.lit("C"), (F.col("user_id") - F.col("user_id") % 3 + F.col("event_id") % 3).cast("string")).alias("src_computer"),
        F.concat(F.lit("C"), F.floor(k * k / 100).cast("string")).alias("dst_computer"),
        pick(F.col("event_type"), {"click": "Kerberos", "view": "?", "purchase": "NTLM", "signup": "Negotiate"}, "Wave").alias("auth_type"),
        pick(F.col("event_id") % 9, {0: "Network", 1: "Network", 2: "?", 3: "Service", 4: "Unlock", 5: "Interactive", 6: "Batch", 7: "NewCredentials"}, "CachedInteractive").alias("logon_type"),
        pick(F.col("event_id") % 3, {0: "LogOn", 1: "LogOff"}, "TGS").alias("auth_orientation"),
        F.when(F.col("event_type") == "error", "Fail").otherwise("Success").alias("success"),
        "ts",
    )


def _case(c, values: dict, other: str):
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def auth_as_redteam(auth: DataFrame) -> DataFrame:
    """Labelled events in bursts of six hours a day, with ghosts one second later that match nothing by themselves."""
    hit = auth.where((F.col("auth_type") == "NTLM") & (F.expr("time div 21600") % 4 == 0) & (F.col("event_id") % 3 == 0))
    rows = hit.select("time", F.col("src_user").alias("user"), "src_computer", "dst_computer")
    ghosts = hit.where(F.col("event_id") % 30 == 0).select((F.col("time") + 1).alias("time"), F.col("src_user").alias("user"), "src_computer", "dst_computer")
    return rows.unionByName(ghosts)


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_auth(spark.read.parquet(f"{sf_dir}/events.parquet"))


def redteam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_as_redteam(auth(spark, sf_dir))


#: DuckDB twins of the adapter, for WITH.
SQL_AUTH = """ev AS (SELECT *, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) AS k FROM events),
auth AS (SELECT event_id, epoch_us(ts)//1000000-1704067200 AS time, concat('U', user_id, '@D1') AS src_user, concat('U', user_id, '@D1') AS dst_user,
  concat('C', user_id - user_id % 3 + event_id % 3) AS src_computer, concat('C', (k * k) // 100) AS dst_computer,
  CASE event_type WHEN 'click' THEN 'Kerberos' WHEN 'view' THEN '?' WHEN 'purchase' THEN 'NTLM' WHEN 'signup' THEN 'Negotiate' ELSE 'Wave' END AS auth_type,
  CASE event_id % 9 WHEN 0 THEN 'Network' WHEN 1 THEN 'Network' WHEN 2 THEN '?' WHEN 3 THEN 'Service' WHEN 4 THEN 'Unlock' WHEN 5 THEN 'Interactive' WHEN 6 THEN 'Batch' WHEN 7 THEN 'NewCredentials' ELSE 'CachedInteractive' END AS logon_type,
  CASE event_id % 3 WHEN 0 THEN 'LogOn' WHEN 1 THEN 'LogOff' ELSE 'TGS' END AS auth_orientation,
  CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END AS success FROM ev)"""
SQL_REDTEAM = """hit AS (SELECT * FROM auth WHERE auth_type = 'NTLM' AND (time // 21600) % 4 = 0 AND event_id % 3 = 0),
redteam AS (SELECT time, src_user AS "user", src_computer, dst_computer FROM hit UNION ALL SELECT time + 1, src_user, src_computer, dst_computer FROM hit WHERE event_id % 30 = 0)"""
