"""Graph clean-up over node and edge tables keyed by sample_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions import bricks
from meshwright.functions.aggregates import weighted_mean
from meshwright.functions.scalars import azimuth_polar, norm
from meshwright.operators.components import connected_components
from meshwright.operators.ordering import quantiles
from meshwright.operators.relational import dedup_edges
from meshwright.shared import tasks, written


def doubled(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Each undirected edge in both directions."""
    back = edges.withColumns({source: F.col(target), target: F.col(source)})
    return edges.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the number of edge ends at each; 0 where there is none."""
    ends = edges.select("sample_id", F.explode(F.array("source", "target")).alias("node")).groupBy("sample_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, ["sample_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


#: Links of a sample's graph, at most, that are joined up in one numpy step; larger graphs go by rounds over all tasks.
WHOLE = 200_000


def _rooted(t: pa.Table) -> pa.Table:
    """Nodes of the graphs of a lot, by their links a, b, with the smallest node of their component."""
    node, ends = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    root = bricks.roots(len(node), ends[: len(t)], ends[len(t) :])
    return pa.table({"node": node, "root": node[root]})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``root``, the smallest node of their component in their sample."""
    kind = nodes.schema["node"].dataType
    key = lambda c: F.xxhash64("sample_id", F.col(c).cast(kind))
    e = edges.filter(F.col("source").cast(kind).isNotNull() & F.col("target").cast(kind).isNotNull())
    e = written(e.select(F.xxhash64("sample_id").alias("s"), key("source").alias("a"), key("target").alias("b")), "graph-links")
    large = written(e.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("s"), "graph-large")
    some = not large.isEmpty()
    lot = F.pmod("s", F.lit(max(tasks(e.sparkSession), -(-e.count() // WHOLE))))
    root = (e.join(large, "s", "left_anti") if some else e).groupBy(lot.alias("lot")).applyInArrow(_rooted, "node bigint, root bigint")
    if some:
        root = root.unionByName(connected_components(e.join(large, "s", "left_semi").select("a", "b")))
    root = root.select(F.col("node").alias("_h"), F.col("root").alias("_root"))
    named = nodes.withColumn("_h", key("node")).join(root, "_h", "left")
    low = named.filter("_root is not null").groupBy("_root").agg(F.min("node").alias("low"))
    return named.join(low, "_root", "left").withColumn("root", F.coalesce("low", "node")).drop("low", "_root", "_h")


def component_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).groupBy("sample_id").agg(F.countDistinct("root").alias("components"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over all graphs: how many there are, their nodes and edges, the most nodes, the least edges, and the whole path length."""
    n = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("m"), F.sum("path_length").alias("w"))
    g = n.join(e, "sample_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return g.agg(F.count(F.lit(1)).alias("graphs"), F.sum("n").alias("nodes"), F.sum("m").alias("edges"), F.max("n").alias("most_nodes"), F.min("m").alias("least_edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("path_length"))


def contract_short_edges(nodes: DataFrame, edges: DataFrame, threshold: float | Column) -> tuple[DataFrame, DataFrame]:
    """Merge the ends of edges shorter than ``threshold``; what merges stands at its weighted centroid.

    A merged node, or one with a junction, is a junction; nodes keep the smallest number of those that merged.
    """
    n = written(components(nodes, edges.filter(F.col("path_length") < threshold)), "graph-contract")
    w = F.col("region_voxels").cast("double")
    merged = n.groupBy("sample_id", "root").agg(
        *[weighted_mean(F.col(c), w).alias(c) for c in "xyz"],
        F.when(F.bool_or(F.col("kind") == "junction") | (F.count(F.lit(1)) > 1), "junction").otherwise(F.min_by("kind", "node")).alias("kind"),
        F.sum("region_voxels").alias("region_voxels"),
    )
    to = n.select("sample_id", "node", "root")
    e = edges.join(to.select("sample_id", F.col("node").alias("source"), F.col("root").alias("_s")), ["sample_id", "source"])
    e = e.join(to.select("sample_id", F.col("node").alias("target"), F.col("root").alias("_t")), ["sample_id", "target"])
    e = dedup_edges(e.withColumns({"source": F.col("_s"), "target": F.col("_t")}).drop("_s", "_t"), group=("sample_id",))
    return merged.withColumnRenamed("root", "node"), e


def prune_spurs(nodes: DataFrame, edges: DataFrame, threshold: float | Column, max_passes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Remove, pass by pass, all edges shorter than ``threshold`` with an end of degree 1, and nodes left without edges."""
    edges = written(edges, "graph-prune")
    for _ in range(max_passes):
        ends = edges.select("sample_id", F.explode(F.array("source", "target")).alias("node")).groupBy("sample_id", "node").agg(F.count(F.lit(1)).alias("d")).filter("d = 1")
        one = ends.select("sample_id", "node")
        spur = edges.filter(F.col("path_length") < threshold).select("sample_id", "source", "target")
        spur = spur.join(one.withColumnRenamed("node", "source"), ["sample_id", "source"], "left_semi").union(spur.join(one.withColumnRenamed("node", "target"), ["sample_id", "target"], "left_semi").select("sample_id", "source", "target"))
        spur = written(spur.distinct(), "graph-spurs")
        if spur.limit(1).count() == 0:
            break
        edges = written(edges.join(spur, ["sample_id", "source", "target"], "left_anti"), "graph-prune")
    used = edges.select("sample_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(used, ["sample_id", "node"], "left_semi"), edges


def connected_only(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that have an edge, numbered from 0 in each sample in order, and the edges between the new numbers."""
    used = edges.select("sample_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    w = Window.partitionBy("sample_id").orderBy("node")
    to = written(used.withColumn("_to", (F.row_number().over(w) - 1).cast("bigint")), "graph-numbers")
    n = nodes.join(to, ["sample_id", "node"]).withColumn("node", F.col("_to")).drop("_to")
    e = edges
    for end in ("source", "target"):
        e = e.join(to.select("sample_id", F.col("node").alias(end), F.col("_to").alias(f"_{end}")), ["sample_id", end])
    return n, e.withColumns({"source": F.col("_source"), "target": F.col("_target")}).drop("_source", "_target")


#: Shares of a sample's median thickness below which edges are merged away, and spurs pruned (fixed values).
SHORT_EDGE, SHORT_SPUR = 0.35, 0.50


def median_thickness(edges: DataFrame) -> DataFrame:
    """(sample_id, median_local_thickness) of the edges' local_thickness_mean, NULL and NaN left out."""
    return quantiles(edges, ["sample_id"], ["local_thickness_mean"], (0.5,)).select("sample_id", F.get("q", F.lit(0)).alias("median_local_thickness"))


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The canonical graph of each sample: parallel edges and loops gone, short edges contracted, spurs pruned, geometry and degrees anew.

    Nodes, edges, and what the traced graphs were: (sample_id, raw_branch_nodes, raw_branch_edges, median_local_thickness).
    Thresholds are shares of that median.
    """
    nodes, e = connected_only(nodes, written(dedup_edges(edges, group=("sample_id",)), "graph-canonical"))
    nodes, e = written(nodes, "graph-nodes"), written(e, "graph-edges")
    raw = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("raw_branch_nodes")).join(e.groupBy("sample_id").agg(F.count(F.lit(1)).alias("raw_branch_edges")), "sample_id").join(median_thickness(e), "sample_id", "left")
    raw = written(raw, "graph-raw")
    e = written(e.join(raw.select("sample_id", F.col("median_local_thickness").alias("_median")), "sample_id", "left"), "graph-canonical")
    nodes, e = connected_only(*contract_short_edges(nodes, e, SHORT_EDGE * F.col("_median")))
    nodes, e = prune_spurs(nodes, e, SHORT_SPUR * F.col("_median"))
    nodes, e = connected_only(nodes, dedup_edges(e, group=("sample_id",)))
    e = recomputed(nodes, e.drop("_median"))
    return written(degrees(nodes, e), "graph-nodes"), written(e, "graph-edges"), raw


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each sample: counts, components, lengths and tortuosity of its canonical graph (nodes with degree)."""
    n = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("simplified_nodes"), F.count_if(F.col("degree") == 1).alias("endpoint_count"), F.count_if(F.col("degree") >= 3).alias("junction_count"))
    e = edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("simplified_edges"), F.sum("path_length").alias("total_path_length"), F.avg("tortuosity").alias("mean_tortuosity"))
    middle = quantiles(edges, ["sample_id"], ["path_length"], (0.5,)).select("sample_id", F.get("q", F.lit(0)).alias("median_path_length"))
    return n.join(e, "sample_id", "left").join(middle, "sample_id", "left").join(component_count(nodes, edges), "sample_id", "left")


def recomputed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chord, path (at least the chord), tortuosity and angles of edges from their ends' positions."""
    at = lambda end, p: nodes.select("sample_id", F.col("node").alias(end), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    e = edges.join(at("source", "s"), ["sample_id", "source"]).join(at("target", "t"), ["sample_id", "target"])
    d = [F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"]
    e = e.withColumn("chord_length", norm(*d)).withColumn("path_length", F.greatest("path_length", "chord_length"))
    az, polar = azimuth_polar(*d)
    return e.withColumns({"tortuosity": F.try_divide("path_length", "chord_length"), "azimuth": az, "polar": polar}).drop(*[f"{p}{c}" for p in "st" for c in "xyz"])


def neighbour_mean(nodes: DataFrame, edges: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """Each node's mean (or sum) of its in-neighbours' columns over directed edges; 0 without neighbours."""
    agg = F.avg if how == "mean" else F.sum
    m = edges.join(nodes.select(F.col("node").alias("source"), "sample_id", *columns), ["sample_id", "source"])
    m = m.groupBy("sample_id", F.col("target").alias("node")).agg(*[agg(c).alias(f"{c}_in") for c in columns])
    return nodes.join(m, ["sample_id", "node"], "left").withColumns({f"{c}_in": F.coalesce(f"{c}_in", F.lit(0.0)) for c in columns})
