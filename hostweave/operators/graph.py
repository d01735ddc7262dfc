"""The host graph as two tables: edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_degrees(edges: DataFrame) -> DataFrame:
    """(host, in_degree, out_degree, in_out_ratio): degrees count distinct neighbours; ratio is in / (out + 1).

    One aggregation over both ends of each edge, rather than a full outer join of two.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst_computer").alias("host"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src_computer").alias("host"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    nodes = ends.groupBy("e.host").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.withColumn("in_out_ratio", F.col("in_degree") / (F.col("out_degree") + 1))


def with_servers(nodes: DataFrame, percentile: float = 95, min_ratio: float = 1.0) -> DataFrame:
    """Adds is_server: in_degree at least the (interpolated) percentile over all nodes, and ratio at least min_ratio."""
    bar = nodes.agg(F.expr(f"percentile(CAST(in_degree AS DOUBLE), {percentile / 100})").alias("bar"))
    return nodes.join(F.broadcast(bar)).withColumn("is_server", (F.col("in_degree") >= F.col("bar")) & (F.col("in_out_ratio") >= min_ratio)).drop("bar")


def target_attractiveness(targets: DataFrame, nodes: DataFrame, keep_ratio: float = 1.5) -> DataFrame:
    """One row: do the attacked hosts have a larger in-degree than hosts at large? targets: dst_computer."""
    seen = targets.select(F.col("dst_computer").alias("host")).distinct().join(nodes, "host")
    t = seen.agg(F.count("*").alias("n_targets"), F.expr("percentile(CAST(in_degree AS DOUBLE), 0.5)").alias("median_target"))
    a = nodes.agg(F.expr("percentile(CAST(in_degree AS DOUBLE), 0.5)").alias("median_all"))
    ratio = F.when(F.col("median_all") > 0, F.col("median_target") / F.col("median_all")).otherwise(F.lit(float("inf")))
    return t.join(F.broadcast(a)).withColumn("ratio", ratio).withColumn("keep", F.coalesce(F.col("ratio") >= keep_ratio, F.lit(False)))


def hub_topn(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.desc("in_degree"), "host").limit(n)


def off_graph(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows whose pair of hosts isn't an edge."""
    return rows.join(edges.select("src_computer", "dst_computer"), ["src_computer", "dst_computer"], "left_anti")


def without_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows on none of the given edges."""
    return off_graph(rows, edges.select("src_computer", "dst_computer").distinct())
