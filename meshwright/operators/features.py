"""Design, node and edge features, and their normalisation fitted on the training split only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.aggregates import mean_std
from meshwright.functions.scalars import one_hot
from meshwright.operators.ordering import quantiles
from meshwright.schemas import ARCHITECTURES


def design_vector(designs: DataFrame) -> DataFrame:
    """Twelve features of each design: architecture, three scalars, and the phases on the circle."""
    trig = [f(c).alias(f"{n}_{c}") for c in ("phase_x_rad", "phase_y_rad", "phase_z_rad") for n, f in (("sin", F.sin), ("cos", F.cos))]
    return designs.select("sample_id", *one_hot(F.col("architecture"), ARCHITECTURES, "arch"), "target_relative_density", "cell_size_mm", "grading_amplitude", *trig)


def node_features(nodes: DataFrame, designs: DataFrame) -> DataFrame:
    """Six continuous features of each node, and two flags of its kind that are never scaled."""
    d = designs.select("sample_id", "target_relative_density")
    return nodes.join(d, "sample_id").select("sample_id", "node", "x", "y", "z", F.col("degree").cast("double").alias("degree"), F.col("region_voxels").cast("double").alias("region_voxels"), F.col("target_relative_density").alias("rho"), (F.col("kind") == "junction").cast("double").alias("is_junction"), (F.col("kind") == "endpoint").cast("double").alias("is_endpoint"))


def surface_box(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, low_x .. high_z, edge_scale): the extent of a surface's points, and the median length of its edges.

    ``points``: sample_id, x, y, z. ``edges``: sample_id, length.
    """
    box = points.groupBy("sample_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    scale = quantiles(edges, ["sample_id"], ["length"], (0.5,)).select("sample_id", F.get("q", F.lit(0)).alias("edge_scale"))
    return box.join(scale, "sample_id", "left")


def structural_features(nodes: DataFrame, box: DataFrame) -> DataFrame:
    """Nodes (sample_id, node, x, y, z, degree) with flags and distances of both ends in z, and places and degrees from 0 to 1.

    A node is at an end within two of the surface's edges, a millionth of the height at least.
    """
    most = nodes.groupBy("sample_id").agg(F.max("degree").alias("_most"))
    n = nodes.join(box, "sample_id").join(most, "sample_id")
    near = F.greatest(2 * F.col("edge_scale"), 1e-6 * (F.col("high_z") - F.col("low_z")))
    norm = {f"{c}_norm": (F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-12)) for c in "xyz"}
    ends = {"bottom_flag": (F.col("z") <= F.col("low_z") + near).cast("int"), "top_flag": (F.col("z") >= F.col("high_z") - near).cast("int"), "dist_to_bottom": F.col("z") - F.col("low_z"), "dist_to_top": F.col("high_z") - F.col("z")}
    return n.withColumns(ends | norm | {"degree_norm": F.col("degree") / F.greatest("_most", F.lit(1))}).select(*nodes.columns, *ends, *norm, "degree_norm")


def edge_features(edges: DataFrame) -> DataFrame:
    """Nine features of each directed edge."""
    trig = [f(c).alias(f"{n}_{c}") for c in ("azimuth", "polar") for n, f in (("sin", F.sin), ("cos", F.cos))]
    return edges.select("sample_id", "source", "target", "path_length", "chord_length", "tortuosity", "local_thickness_mean", "local_thickness_min", *trig)


def zscored(df: DataFrame, fit_on: DataFrame, columns: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` less the mean and over the std of ``fit_on``; one row of statistics is broadcast."""
    stats = mean_std(fit_on, columns, fixed).drop("n_fit")
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*stats.columns)
