"""What a finished sample must satisfy: rules of success, of its graph, and gates of geometry, mesh, mapping and convergence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.scalars import close, finite, percent_change
from meshwright.operators.ordering import quantiles

# Fixed values.
REQUIRED_FILES = ("SUCCESS.txt", "metadata.json", "canonical_nodes.csv", "canonical_edges.csv", "mapping_k32.npz", "target_scalar_elements.npz", "graph_targets_scalar.npz")
TARGETS = ("von_mises_stress", "equivalent_strain")
MESH_LABEL, MAPPING_K, IDW_POWER, MAX_RADIUS_P95 = "S250k", 32, 2.0, 0.50
KINDS = ("junction", "endpoint")
MAX_DENSITY_ERROR, MIN_SOLID_VOXELS, MIN_SURFACE_FACES = 0.010, 5000, 2000
MAX_TETS, MAX_NODES, ZERO_VOLUME, MIN_QUALITY_Q01, MAX_EDGE_RATIO_P99, MIN_END_NODES = 5_000_000, 1_300_000, 1e-14, 0.10, 8.0, 100
MIN_COVERAGE = 0.999
ARRAY_FILES = ("mapping_k32.npz", "target_scalar_elements.npz", "graph_targets_scalar.npz")
#: Gate, metric of two resolutions, and the percent that it may change between them (fixed values).
CONVERGENCE = (
    ("junctions_converged_10pct", "junction_count", 10), ("edges_converged_25pct", "simplified_edges", 25), ("path_length_converged_15pct", "total_path_length", 15),
    ("thickness_converged_15pct", "median_local_thickness", 15), ("tortuosity_converged_10pct", "mean_tortuosity", 10),
)
#: Features that must be finite.
NODE_FEATURES = ("x_norm", "y_norm", "z_norm", "degree_norm", "top_flag", "bottom_flag", "dist_to_bottom", "dist_to_top")
EDGE_FEATURES = ("path_length", "chord_length", "tortuosity", "azimuth", "polar", "local_thickness_mean", "local_thickness_min", "voxel_count")


def _said(name: str, value: Column, wrong: Column, none: str = "None") -> Column:
    """``name=value`` where a rule is broken; an unknown outcome breaks it."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(none))))


def _listed(x: Column) -> Column:
    """An array of strings as ['a', 'b']."""
    return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]")))


def _number(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def success_issues() -> Column:
    """The messages of the rules that a success breaks, in order.

    Rows have files (names), expected_id, expected_architecture, expected_split; meta: a struct of the metadata, null where
    it can't be read, and then meta_error; arrays: a list of (file, error, nonfinite) for each file of arrays that is there,
    with the reason why it can't be read, or the names of arrays that have other than finite numbers.
    """
    m = lambda c: F.col(f"meta.{c}")
    missing = F.filter(F.array(*[F.lit(f) for f in REQUIRED_FILES]), lambda x: ~F.array_contains("files", x))
    meta = F.array(
        _said("metadata_sample_id", m("sample_id"), m("sample_id") != F.col("expected_id")),
        _said("metadata_architecture", m("architecture"), F.lower(m("architecture")) != F.col("expected_architecture")),
        _said("metadata_iid_split", m("iid_split"), F.lower(m("iid_split")) != F.col("expected_split")),
        F.when(~F.coalesce(m("checkpoint_verified"), F.lit(False)), "checkpoint_verified_not_true"),
        F.when(~F.coalesce(m("solver_completed"), F.lit(False)), "solver_completed_not_true"),
        _said("ccx_returncode", m("ccx_returncode"), m("ccx_returncode") != 0),
        _said("mesh_label", m("mesh_label"), m("mesh_label") != MESH_LABEL),
        _said("mapping_k", m("mapping_k"), m("mapping_k") != MAPPING_K),
        _said("idw_power", m("idw_power"), ~close(m("idw_power"), F.lit(IDW_POWER))),
        F.when(F.coalesce(m("full_tensor_targets_authorized"), F.lit(True)), "full_tensor_targets_authorized_not_false"),
        _said("authorized_targets", _listed(m("authorized_targets")), m("authorized_targets") != F.array(*[F.lit(x) for x in TARGETS])),
        _said("graph_components", m("graph_components"), m("graph_components") != 1),
        _said("zero_volume_tets", m("zero_volume_tets"), m("zero_volume_tets") != 0),
        _said("k32_radius_p95_mm", _number(m("k32_radius_p95_mm")), ~(finite(m("k32_radius_p95_mm")) & (m("k32_radius_p95_mm") <= MAX_RADIUS_P95))),
    )
    there = F.array_contains("files", "metadata.json") & F.col("meta").isNull()
    files = F.array(F.when(F.size(missing) > 0, F.concat(F.lit("missing_success_files="), F.array_join(missing, ","))), F.when(there, F.concat(F.lit("metadata_json_error="), F.coalesce("meta_error", F.lit("unknown")))))
    arrays = []
    for name in ARRAY_FILES:
        a = F.get(F.filter("arrays", lambda x: x["file"] == name), F.lit(0))  # noqa: B023
        bad = F.concat(F.lit(f"{name}_unreadable="), a["error"])
        arrays.append(F.when(a["error"].isNotNull(), bad).when(F.size(a["nonfinite"]) > 0, F.concat(F.lit(f"{name}_nonfinite_keys="), _listed(a["nonfinite"]))))
    return F.array_compact(F.concat(files, F.when(F.col("meta").isNotNull(), meta).otherwise(F.array().cast("array<string>")), F.array(*arrays)))


def graph_issues(samples: DataFrame, nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, issues): what is wrong with each sample's graph; an empty array where nothing is.

    ``samples``: sample_id, graph_nodes and graph_edges as recorded. Nodes: node, kind. Edges: source, target.
    ``targets``: node, y_vm, y_eq. Each table is counted once by sample, and the counts are joined.
    """
    ok = lambda p: F.bool_and(F.coalesce(p, F.lit(False)))
    n = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.countDistinct("node").alias("different"), ok(F.col("kind").isin(*KINDS)).alias("kinds"))
    e = edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("m"), F.min(F.least("source", "target")).alias("first"), F.max(F.greatest("source", "target")).alias("last"), F.bool_or(F.col("source") == F.col("target")).alias("loops"))
    y = [F.col("y_vm"), F.col("y_eq")]
    t = targets.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k"), ok(finite(y[0]) & finite(y[1])).alias("finite"), F.bool_or((y[0] < 0) | (y[1] < 0)).alias("negative"))
    s = samples.join(n, "sample_id", "left").join(e, "sample_id", "left").join(t, "sample_id", "left")
    rules = {
        "node_kind": ~F.col("kinds"),
        "node_count": F.col("graph_nodes") != F.col("n"),
        "edge_count": F.col("graph_edges") != F.col("m"),
        "ids_not_contiguous": (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("different") != F.col("n")),
        "endpoint_out_of_range": F.col("m").isNull() | (F.col("first") < 0) | (F.col("last") >= F.col("n")),
        "self_loop": F.coalesce("loops", F.lit(False)),
        "target_length": F.col("k") != F.col("n"),
        "target_not_finite": ~F.col("finite"),
        "target_negative": F.coalesce("negative", F.lit(False)),
    }
    return s.select("sample_id", F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(True)), name) for name, p in rules.items()])).alias("issues"))


def geometry_pass(contacts: list[str]) -> Column:
    """Whether a sample's geometry passes: density, voxels, one component, a closed surface, and contact with all six faces.

    A sample that was screened without a surface (surface_faces is null) has no surface to fail by.
    """
    surface = (F.col("surface_faces") >= MIN_SURFACE_FACES) & F.col("watertight") & F.col("winding_consistent") & (F.col("surface_components") == 1)
    conditions = [F.col("density_abs_error") <= MAX_DENSITY_ERROR, F.col("solid_voxels") >= MIN_SOLID_VOXELS, F.col("solid_components") <= 1, F.col("surface_faces").isNull() | surface, *[F.col(c) for c in contacts]]
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def mesh_gates(tets: DataFrame, points: DataFrame, ends: DataFrame) -> DataFrame:
    """Each sample's counts, quality quantiles and whether its mesh passes.

    ``tets``: sample_id, volume, quality, edge_ratio; ``points``: sample_id, nid; ``ends``: sample_id, end, nid.
    """
    n = tets.groupBy("sample_id").agg(F.count(F.lit(1)).alias("tets"), F.count_if(F.col("volume") <= ZERO_VOLUME).alias("zero_volume"))
    q = quantiles(tets, ["sample_id"], ["quality", "edge_ratio"], (0.01, 0.99)).groupBy("sample_id").agg(F.max(F.when(F.col("name") == "quality", F.get("q", F.lit(0)))).alias("quality_q01"), F.max(F.when(F.col("name") == "edge_ratio", F.get("q", F.lit(1)))).alias("edge_ratio_p99"))
    p = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = ends.groupBy("sample_id").agg(F.count_if(F.col("end") == "bottom").alias("bottom"), F.count_if(F.col("end") == "top").alias("top"))
    s = n.join(q, "sample_id", "left").join(p, "sample_id", "left").join(e, "sample_id", "left")
    ok = (F.col("tets") <= MAX_TETS) & (F.col("nodes") <= MAX_NODES) & (F.col("zero_volume") == 0) & (F.col("quality_q01") >= MIN_QUALITY_Q01) & (F.col("edge_ratio_p99") <= MAX_EDGE_RATIO_P99) & (F.least("bottom", "top") > MIN_END_NODES)
    return s.withColumn("pass", F.coalesce(ok, F.lit(False)))


def radius_gate(neighbours: DataFrame, k: int, limit: float = MAX_RADIUS_P95) -> DataFrame:
    """One row: the 95th percentile of the distance to the nearest and to the k-th neighbour, and whether the latter is small enough."""
    q = quantiles(neighbours.select(F.when(F.col("rank") == 1, F.col("dist")).alias("nearest"), F.when(F.col("rank") == k, F.col("dist")).alias("radius")), [], ["nearest", "radius"], (0.95,))
    one = q.agg(*[F.max(F.when(F.col("name") == c, F.get("q", F.lit(0)))).alias(f"{c}_p95") for c in ("nearest", "radius")])
    return one.withColumn("pass", F.coalesce(F.col("radius_p95") <= limit, F.lit(False)))


def coverage_gate(wanted: DataFrame, records: DataFrame, sections: tuple[str, ...] = ("stress", "strain")) -> DataFrame:
    """(section, wanted, found, coverage, pass): whether nearly all wanted ids have a record in each section."""
    s = wanted.sparkSession.createDataFrame([(x,) for x in sections], "section string")
    hit = wanted.select("id").distinct().crossJoin(F.broadcast(s)).join(records.select("section", "id", F.lit(1).alias("hit")).distinct(), ["section", "id"], "left")
    out = hit.groupBy("section").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("coverage", F.col("found") / F.col("wanted")).withColumn("pass", F.col("coverage") >= MIN_COVERAGE)


def convergence_gates(summaries: DataFrame, nodes: DataFrame, edges: DataFrame, coarse: int, fine: int) -> DataFrame:
    """(sample_id, gate, status): PASS or WARN for each sample's graph at two resolutions.

    ``summaries``: a row for each sample and resolution, with components and the metrics of ``CONVERGENCE``. ``nodes`` and
    ``edges`` are those of the coarse resolution, with ``NODE_FEATURES`` and ``EDGE_FEATURES``; none at all have nothing to fail by.
    """
    at = lambda c, r: F.max(F.when(F.col("resolution") == r, F.col(c).cast("double")))
    all_finite = lambda columns: F.bool_and(reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")) for c in columns]))
    gates = {"canonical_connected": at("components", coarse) == 1, "sensitivity_connected": at("components", fine) == 1}
    gates |= {name: percent_change(at(c, coarse), at(c, fine)) <= most for name, c, most in CONVERGENCE}
    row = summaries.groupBy("sample_id").agg(*[F.coalesce(p, F.lit(False)).alias(name) for name, p in gates.items()])
    n = nodes.groupBy("sample_id").agg(all_finite(NODE_FEATURES).alias("node_features_finite"))
    e = edges.groupBy("sample_id").agg(all_finite(EDGE_FEATURES).alias("edge_features_finite"), F.bool_and(F.col("source") != F.col("target")).alias("no_self_loops"))
    row = row.join(n, "sample_id", "left").join(e, "sample_id", "left")
    every = [*gates, "node_features_finite", "edge_features_finite", "no_self_loops"]
    status = [F.struct(F.lit(g).alias("gate"), F.when(F.coalesce(g, F.lit(True)), "PASS").otherwise("WARN").alias("status")) for g in every]
    return row.select("sample_id", F.explode(F.array(*status)).alias("x")).select("sample_id", "x.*")


def freeze_gates(index: DataFrame, assigned: DataFrame, expected: int = 20) -> DataFrame:
    """(worker, gate, pass): whether each worker's finished samples may be frozen.

    ``assigned``: worker, sample_id, architecture (the worker's). ``index``: worker, sample_id and the metadata of each finished sample.
    """
    i = index.join(assigned.select("worker", "sample_id", F.lit(True).alias("_own")), ["worker", "sample_id"], "left").join(assigned.groupBy("worker").agg(F.min("architecture").alias("_architecture")), "worker", "left")
    every = lambda p: F.bool_and(F.coalesce(p, F.lit(False)))
    gates = {
        f"exactly {expected} assigned checkpoints": (F.count(F.lit(1)) == expected) & (F.countDistinct("sample_id") == expected),
        "exact frozen ID set": (F.count_if(F.col("_own").isNull()) == 0) & (F.countDistinct("sample_id") == F.max("_assigned")),
        "all of the worker's architecture": every(F.col("architecture") == F.col("_architecture")),
        "all solver return codes zero": every(F.col("ccx_returncode") == 0),
        "all checkpoints verified": every(F.col("checkpoint_verified") & F.col("solver_completed")),
        "all mesh resource gates pass": every((F.col("mesh_tets") <= MAX_TETS) & (F.col("mesh_nodes") <= MAX_NODES)),
        "all mesh quality gates pass": every((F.col("mesh_q01") >= MIN_QUALITY_Q01) & (F.col("mesh_edge_ratio_p99") <= MAX_EDGE_RATIO_P99)),
        "all mapping gates pass": every(F.col("k32_radius_p95_mm") <= MAX_RADIUS_P95),
        "scalar targets only": every(~F.col("full_tensor_targets_authorized")),
    }
    i = i.join(assigned.groupBy("worker").agg(F.countDistinct("sample_id").alias("_assigned")), "worker", "left")
    row = i.groupBy("worker").agg(*[F.coalesce(p, F.lit(False)).alias(g) for g, p in gates.items()])
    row = assigned.select("worker").distinct().join(row, "worker", "left")
    return row.select("worker", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(F.col(f"`{g}`"), F.lit(False)).alias("pass")) for g in gates])).alias("x")).select("worker", "x.*")


def finalisation(audit: DataFrame, expected: int = 120) -> DataFrame:
    """One row: how many of the audited samples are in each state, and whether the audit may be finalised.

    decision: INVALID where a checkpoint is, REFUSED_UNFINISHED where one is missing, REFUSED_ACCOUNTING where finished ones
    don't add up to ``expected``, else FINALIZED.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    row = audit.agg(is_("VERIFIED").alias("verified"), is_("TERMINAL_QC_FAILURE").alias("terminal_qc_failures"), is_("MISSING_OR_IN_PROGRESS").alias("unfinished"), F.count_if(F.col("status").startswith("INVALID")).alias("invalid"))
    decision = F.when(F.col("invalid") > 0, "INVALID").when(F.col("unfinished") > 0, "REFUSED_UNFINISHED").when(F.col("verified") + F.col("terminal_qc_failures") != expected, "REFUSED_ACCOUNTING").otherwise("FINALIZED")
    return row.withColumn("decision", decision)


def target_summary(targets: DataFrame, reactions: DataFrame, displacement: float) -> DataFrame:
    """One row for each sample: least, median, 95th percentile and largest of both targets, reactions in all, and apparent stiffness.

    ``targets``: sample_id, y_vm, y_eq of a graph's nodes. ``reactions``: sample_id, x, y, z of the top's nodes.
    """
    q = quantiles(targets, ["sample_id"], ["y_vm", "y_eq"], (0.0, 0.5, 0.95, 1.0))
    of = {f"{short}_graph_{name}{unit}": F.max(F.when(F.col("name") == c, F.get("q", F.lit(i)))) for c, short, unit in (("y_vm", "vm", "_MPa"), ("y_eq", "eq", "")) for i, name in enumerate(("min", "median", "p95", "max"))}
    t = q.groupBy("sample_id").agg(*[v.alias(k) for k, v in of.items()])
    r = reactions.groupBy("sample_id").agg(*[F.sum(c).alias(f"reaction_{c}_N") for c in "xyz"])
    return t.join(r, "sample_id", "left").withColumn("apparent_stiffness_N_per_mm", F.abs(F.col("reaction_z_N") / displacement))
