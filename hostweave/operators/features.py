"""Per-event features. Lookups are keyed uniquely, so each input row gives one output row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.operators.aggregates import cred_host_counts, total_weight
from hostweave.schema import AUTH_TYPES, LOGON_TYPES

#: What an unseen edge weighs: less than any observed one, so that it is rarer than all.
UNSEEN = 0.5
STRUCTURAL = ["edge_rarity", "dst_in_degree", "src_out_degree", "n_hosts_for_cred"]
ATTRIBUTE = [f"auth_{t}" for t in AUTH_TYPES] + [f"logon_{t}" for t in LOGON_TYPES]
GROUPS = {"structural": STRUCTURAL, "attribute": ATTRIBUTE}
#: Hosts up to this number are broadcast to the events, so that events on a hub aren't shuffled to one task.
BROADCAST_HOSTS = 2_000_000


def edge_rarity(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds edge_rarity = ln(total weight / weight)."""
    total = F.broadcast(total_weight(edges))
    seen = rows.join(edges.select("src_computer", "dst_computer", "weight"), ["src_computer", "dst_computer"], "left").join(total)
    return seen.withColumn("edge_rarity", F.ln(F.col("total_weight") / F.coalesce(F.col("weight").cast("double"), F.lit(UNSEEN)))).drop("weight", "total_weight")


def structural(rows: DataFrame, edges: DataFrame, nodes: DataFrame, user_host: DataFrame) -> DataFrame:
    """Adds the four structural features; hosts and users that the graph lacks have 0."""
    few = nodes.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    side = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    out = edge_rarity(rows, edges)
    out = out.join(side(nodes.select(F.col("host").alias("dst_computer"), F.col("in_degree").alias("dst_in_degree"))), "dst_computer", "left")
    out = out.join(side(nodes.select(F.col("host").alias("src_computer"), F.col("out_degree").alias("src_out_degree"))), "src_computer", "left")
    out = out.join(cred_host_counts(user_host).select(F.col("user").alias("src_user"), F.col("n_hosts").alias("n_hosts_for_cred")), "src_user", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in STRUCTURAL[1:]})


def _one_hot(column: str, vocabulary: list[str], prefix: str) -> dict[str, Column]:
    known = F.when(F.col(column) == "?", "unknown").otherwise(F.col(column))
    value = F.when(known.isin(vocabulary), known).otherwise("other")
    return {f"{prefix}_{v}": (value == v).cast("double") for v in vocabulary}


def attributes(rows: DataFrame) -> DataFrame:
    """Adds one-hots over fixed vocabularies: `?` is unknown, and a null or any other value is other."""
    return rows.withColumns(_one_hot("auth_type", AUTH_TYPES, "auth") | _one_hot("logon_type", LOGON_TYPES, "logon"))


def build_features(rows: DataFrame, edges: DataFrame, nodes: DataFrame, user_host: DataFrame, *, groups: tuple[str, ...] = ("structural", "attribute"), keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and the features of the named groups, in their fixed order."""
    if not groups or set(groups) - set(GROUPS):
        raise ValueError(f"groups must be some of {sorted(GROUPS)}, not {groups!r}")
    out = rows
    if "structural" in groups:
        out = structural(out, edges, nodes, user_host)
    if "attribute" in groups:
        out = attributes(out)
    return out.select(*keep, *[c for g in GROUPS if g in groups for c in GROUPS[g]])


def credential_novelty(rows: DataFrame, user_host: DataFrame) -> DataFrame:
    """Opt-in: 1 where the fit window hasn't seen the user on the destination. In no default group."""
    seen = user_host.select(F.col("user").alias("src_user"), F.col("computer").alias("dst_computer"), F.lit(0.0).alias("credential_novelty"))
    return rows.join(seen, ["src_user", "dst_computer"], "left").withColumn("credential_novelty", F.coalesce("credential_novelty", F.lit(1.0)))


def candidate_features(rows: DataFrame) -> DataFrame:
    """Opt-in: is_self_auth and is_machine_account."""
    return rows.withColumns({"is_self_auth": (F.col("src_computer") == F.col("dst_computer")).cast("double"), "is_machine_account": F.col("src_user").like("%$@%").cast("double")})
