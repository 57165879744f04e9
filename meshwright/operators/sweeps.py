"""From designs to canonical graphs, and how much these change with resolution and neighbourhood."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions.kernels import distance_transform
from meshwright.functions.scalars import percent_change
from meshwright.operators import features, geometry, graphs, skeletons, surfaces
from meshwright.operators.ordering import quantiles
from meshwright.shared import written

#: Metrics whose change between resolutions is reported, and shares of the path lengths' quantiles (fixed values).
METRICS = ("simplified_nodes", "simplified_edges", "total_path_length", "median_path_length", "mean_tortuosity", "median_local_thickness", "endpoint_count", "junction_count")
LENGTH_SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)


class Analysis(NamedTuple):
    """What came of each sample: its solid and skeleton voxels, its canonical graph, and one row of figures."""

    solid: DataFrame
    skeleton: DataFrame
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def analysed(designs: DataFrame, n: int, connectivity: int = 26) -> Analysis:
    """The canonical graph of each design on an n^3 grid: field, calibrated mask, distances, skeleton, branches, clean-up."""
    pitch = geometry.SIDE / n
    grid = written(geometry.masked(geometry.field(designs, n)).select("sample_id", "id", "i", "j", "k", "solid"), "sweep-grid")
    solid = grid.filter("solid").drop("solid")
    depth = distance_transform(grid).filter("distance > 0").select("sample_id", "i", "j", "k", (2 * F.col("distance")).alias("thickness"))
    skeleton = written(skeletons.thinned(solid).hint("merge").join(depth, ["sample_id", "i", "j", "k"]), "sweep-skeleton")
    nodes, edges, raw = graphs.canonical(*skeletons.graph(skeleton, pitch, geometry.ORIGIN, connectivity))
    count = lambda df, name: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))
    s = count(solid, "solid_voxels").join(count(skeleton, "skeleton_voxels"), "sample_id").join(raw, "sample_id", "left").join(graphs.summary(nodes, edges), "sample_id", "left")
    thresholds = {"contract_threshold": graphs.SHORT_EDGE * F.col("median_local_thickness"), "spur_threshold": graphs.SHORT_SPUR * F.col("median_local_thickness")}
    return Analysis(solid, skeleton, nodes, edges, written(s.withColumns(thresholds).withColumn("resolution", F.lit(n)), "sweep-summary"))


def sweep(designs: DataFrame, resolutions: tuple[int, ...]) -> dict[int, Analysis]:
    """The analysis at each resolution."""
    return {n: analysed(designs, n) for n in resolutions}


def summaries(found: dict[int, Analysis]) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.summary for a in found.values()])


def changes(rows: DataFrame) -> DataFrame:
    """(sample_id, comparison, and a percentage for each metric): how figures change from each resolution to the next."""
    w = Window.partitionBy("sample_id").orderBy("resolution")
    before = [F.lag(F.col(m).cast("double")).over(w).alias(f"_{m}") for m in METRICS]
    r = rows.select("*", *before, F.lag("resolution").over(w).alias("_was")).filter("_was is not null")
    return r.select("sample_id", F.concat(F.col("_was"), F.lit("->"), F.col("resolution")).alias("comparison"), *[percent_change(F.col(f"_{m}"), F.col(m).cast("double")).alias(f"{m}_pct") for m in METRICS])


def length_quantiles(found: dict[int, Analysis]) -> DataFrame:
    """(sample_id, resolution, L_q10 .. L_q90) of the canonical edges' path lengths."""
    each = reduce(DataFrame.unionByName, [a.edges.select("sample_id", F.lit(n).alias("resolution"), "path_length") for n, a in found.items()])
    q = quantiles(each, ["sample_id", "resolution"], ["path_length"], LENGTH_SHARES)
    return q.select("sample_id", "resolution", *[F.col("q")[i].alias(f"L_q{round(100 * p)}") for i, p in enumerate(LENGTH_SHARES)])


def structural_nodes(a: Analysis, n: int) -> DataFrame:
    """The canonical nodes with flags, distances and places relative to the surface around the solid."""
    faces = written(surfaces.isosurface(a.solid), "sweep-faces")
    points = written(surfaces.vertices(faces, geometry.SIDE / n, geometry.ORIGIN), "sweep-points")
    sides = geometry.directed(faces).select("sample_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    u, v = (surfaces.place(end, geometry.SIDE / n, geometry.ORIGIN) for end in "uv")
    length = F.sqrt(sum(((u[c] - v[c]) * (u[c] - v[c]) for c in "xyz"), F.lit(0.0)))
    lengths = written(sides.select("sample_id", length.alias("length")), "sweep-lengths")
    return features.structural_features(a.nodes, features.surface_box(points, lengths))
