"""Connected components of a table of links, by large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large star links each larger neighbour to the smallest one, small star the others."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    pairs = near.join(least, "u")
    if large:
        out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """links: (u, v), any order. Returns (id, root): the smallest id reachable, for every id in a link other than a root."""
    edges = ws.put(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before, k = (state["n"], state["h"]), k + 1
        edges = ws.put(_star(_star(edges, True), False), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
