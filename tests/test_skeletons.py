"""Thinning, regions, branches, surfaces and sweeps against brute force and analytic cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import kernels
from meshwright.operators import geometry, graphs, skeletons, surfaces, sweeps

VOXELS = "sample_id string, id bigint, i bigint, j bigint, k bigint"


def table(spark, masks):
    rows = [(name, int((i * 64 + j) * 64 + k), int(i), int(j), int(k)) for name, m in masks.items() for i, j, k in np.argwhere(m)]
    return spark.createDataFrame(rows, VOXELS)


def back(df, like):
    out = {name: np.zeros_like(m) for name, m in like.items()}
    for r in df.collect():
        out[r["sample_id"]][r["i"], r["j"], r["k"]] = True
    return out


def pieces(cells, within):
    """Sets of cells that hang together: neighbours differ by at most 1 in each axis and ``within`` in sum."""
    left, out = set(cells), []
    while left:
        todo, got = [left.pop()], set()
        while todo:
            p = todo.pop()
            got.add(p)
            near = [tuple(a + b for a, b in zip(p, s, strict=True)) for s in skeletons.NEIGHBOURS if sum(map(abs, s)) <= within]
            todo += [q for q in near if q in left]
            left -= set(near)
        out.append(got)
    return out


def plain_simple(around):
    """The definition, on a 3^3 neighbourhood: one solid piece, and one empty piece that shares a face with the middle."""
    solid = [p for p in skeletons.NEIGHBOURS if around[tuple(np.array(p) + 1)]]
    empty = [p for p in skeletons.NEIGHBOURS if not around[tuple(np.array(p) + 1)] and sum(map(abs, p)) <= 2]
    facing = [s for s in pieces(empty, 1) if any(sum(map(abs, p)) == 1 for p in s)]
    return len(pieces(solid, 3)) == 1 and len(facing) == 1


def plain_thinned(mask):
    """The same order, one voxel after another, on the whole grid."""
    solid = np.pad(mask, 2)
    while True:
        outer = [p for p in map(tuple, np.argwhere(solid)) if any(not solid[tuple(np.array(p) + s)] for s in skeletons.NEIGHBOURS if sum(map(abs, s)) == 1)]
        gone = 0
        for parity in itertools.product((0, 1), repeat=3):
            for p in outer:
                if tuple(c % 2 for c in p) == parity:
                    around = solid[tuple(slice(c - 1, c + 2) for c in p)]
                    if around.sum() > 2 and plain_simple(around):
                        solid[p] = False
                        gone += 1
        if not gone:
            return solid[2:-2, 2:-2, 2:-2]


def test_simple_codes():
    rng = np.random.default_rng(2)
    around = rng.random((400, 3, 3, 3)) < rng.random((400, 1, 1, 1))
    around[:, 1, 1, 1] = True
    codes = np.array([sum(1 << b for b, p in enumerate(skeletons.NEIGHBOURS) if a[tuple(np.array(p) + 1)]) for a in around], dtype=np.uint32)
    assert skeletons.simple(codes).tolist() == [plain_simple(a) for a in around]


def some_masks():
    rng = np.random.default_rng(7)
    g = np.indices((8, 8, 8))
    masks = {f"r{k}": rng.random((8, 8, 8)) < 0.25 + 0.1 * k for k in range(4)}
    masks["tube"] = ((g[0] - 3.5) ** 2 + (g[1] - 3.5) ** 2 < 14) & ((g[0] - 3.5) ** 2 + (g[1] - 3.5) ** 2 > 4)
    masks["shell"] = ((g - 3.5) ** 2).sum(0) < 12
    masks["shell"][3:5, 3:5, 3:5] = False
    masks["full"] = np.ones((8, 8, 8), dtype=bool)
    return masks


@pytest.fixture(scope="module")
def skeleton(spark):
    masks = some_masks()
    return masks, back(skeletons.thinned(table(spark, masks)), masks)


def test_thinning_equals_brute_force(skeleton):
    masks, got = skeleton
    for name, m in masks.items():
        assert (got[name] == plain_thinned(m)).all(), name


def test_thinning_keeps_topology(spark, skeleton):
    masks, got = skeleton
    count = lambda df: {r["sample_id"]: r["n"] for r in geometry.labelled(df).groupBy("sample_id").agg(F.countDistinct("root").alias("n")).collect()}
    number = lambda df: {r["sample_id"]: r["euler"] for r in skeletons.euler(df).collect()}
    before, after = table(spark, masks), table(spark, got)
    assert count(before) == count(after) == {name: len(pieces(map(tuple, np.argwhere(m)), 3)) for name, m in masks.items()}
    assert number(before) == number(after) and number(after)["tube"] == 0 and number(after)["shell"] == 2 and number(after)["full"] == 1


def test_bricks_and_places_make_no_difference(spark):
    g = np.indices((30, 26, 11))
    m = {"a": (np.sin(g[0] / 2.5) * np.cos(g[1] / 3) + np.sin(g[2] / 2) > 0.1), "b": g[0] > 24}
    want = back(skeletons.thinned(table(spark, m), brick=64), m)
    got = back(skeletons.thinned(table(spark, m), brick=9), m)
    assert all((got[k] == want[k]).all() for k in m)
    moved = skeletons.thinned(table(spark, m).withColumns({"i": F.col("i") - 20, "k": F.col("k") + 100}), brick=9)
    assert all((v == want[k]).all() for k, v in back(moved.withColumns({"i": F.col("i") + 20, "k": F.col("k") - 100}), m).items())
    with pytest.raises(ValueError):
        skeletons.thinned(table(spark, m), brick=4)


def test_thinning_of_nothing(spark):
    assert skeletons.thinned(spark.createDataFrame([], VOXELS)).count() == 0


def test_branches_of_rings_dead_ends_and_long_ways(spark):
    line = [(x, 0, 0) for x in range(101)]  # one long branch
    ring = [(0, y, 20) for y in range(6)] + [(5, y, 20) for y in range(6)] + [(x, 0, 20) for x in range(1, 5)] + [(x, 5, 20) for x in range(1, 5)]
    tailed = [(x, y, z + 20) for x, y, z in ring] + [(6, 2, 40), (7, 2, 40), (8, 2, 40)]
    alone = [(50, 50, 50)]
    rows = [("s", n, *p, 1.0 + n % 3) for n, p in enumerate(line + ring + tailed + alone)]
    sk = spark.createDataFrame(rows, VOXELS + ", thickness double")
    pairs = geometry.adjacent(sk, 6)
    voxels = skeletons.region_voxels(sk.drop("thickness"), pairs)
    kinds = {r["node"]: r["kind"] for r in skeletons.regions(voxels).collect()}
    got = {(r["source"], r["target"]): r for r in skeletons.branches(sk, pairs, voxels).collect()}
    assert sorted(kinds.values()) == ["endpoint"] * 3 + ["isolated", "junction"]
    assert got[0, 100]["steps"] == 100 and got[0, 100]["voxel_count"] == 101 and got[0, 100]["thickness_sum"] == sum(1 + n % 3 for n in range(101)) and got[0, 100]["thickness_min"] == 1
    assert len(got) == 2 and sorted(r["voxel_count"] for r in got.values()) == [4, 101]  # the ring and the loop at the tail are none
    nodes, edges = skeletons.graph(sk, 0.5, (1.0, 0.0, 0.0), 6)
    assert {(r["source"], r["target"]): r["path_length"] for r in edges.collect()}[0, 100] == 50
    assert [r["x"] for r in nodes.filter("node = 100").collect()] == [1 + 100.5 * 0.5]


def test_surface_of_a_ball_and_of_any_mask(spark):
    g = np.indices((24, 24, 24)) - 11.5
    rng = np.random.default_rng(1)
    masks = {"ball": (g**2).sum(0) < 100, "two": np.zeros((24, 24, 24), dtype=bool), "any": np.zeros((24, 24, 24), dtype=bool)}
    masks["two"][2:5, 2:5, 2:5] = masks["two"][5, 5, 2:4] = True
    masks["any"][:7, :7, :7] = rng.random((7, 7, 7)) < 0.5
    f = surfaces.isosurface(table(spark, masks)).cache()
    p = surfaces.vertices(f)
    m = {r["sample_id"]: r for r in geometry.surface_measures(f, p).collect()}
    assert all(r["watertight"] and r["winding_consistent"] and r["volume"] > 0 for r in m.values())
    assert m["ball"]["volume"] == pytest.approx(masks["ball"].sum(), rel=0.02) and m["ball"]["area"] == pytest.approx(4 * np.pi * 100, rel=0.12)
    parts = {r["sample_id"]: r["components"] for r in surfaces.surface_components(f).collect()}
    assert parts["ball"] == 1 and parts["two"] == 2  # what touches by an edge only stays apart
    box = p.filter("sample_id = 'two'").agg(F.min("x"), F.max("x")).first()
    assert tuple(box) == (2.0, 6.0)  # voxels 2 to 5, whose centres lie half a voxel inside


def test_cases_are_closed():
    for triangles in surfaces.cases().values():
        edges = [(t[a], t[b]) for t in triangles for a, b in ((0, 1), (1, 2), (2, 0))]
        rim = [e for e in edges if e[::-1] not in edges]
        assert len(set(edges)) == len(edges) and all(surfaces._shared_face(*e) for e in rim)


def plain_distance(solid):
    empty = np.argwhere(~solid)
    return {tuple(p): np.sqrt(((empty - p) ** 2).sum(1).min()) if len(empty) else np.inf for p in np.argwhere(np.ones_like(solid))}


def test_distances(spark):
    rng = np.random.default_rng(0)
    masks = {"a": rng.random((9, 5, 7)) < 0.8, "b": np.ones((9, 5, 7), dtype=bool), "c": np.zeros((9, 5, 7), dtype=bool), "d": rng.random((9, 5, 7)) < 0.99}
    rows = [(name, *map(int, p), bool(m[tuple(p)])) for name, m in masks.items() for p in np.argwhere(np.ones_like(m))]
    got = {(r["sample_id"], r["i"], r["j"], r["k"]): r["distance"] for r in kernels.distance_transform(spark.createDataFrame(rows, "sample_id string, i int, j int, k int, solid boolean")).collect()}
    for name, m in masks.items():
        for p, d in plain_distance(m).items():
            assert got[name, *map(int, p)] == pytest.approx(d)


def test_sweep(spark):
    d = spark.createDataFrame([("p", "primitive", 0.3, 9.0, "uniform", 0.0, 0.4, 0.7, 0.2), ("g", "gyroid", 0.35, 10.0, "linear", 0.1, 0.3, 0.2, 0.1)], "sample_id string, architecture string, target_relative_density double, cell_size_mm double, grading_mode string, grading_amplitude double, phase_x_rad double, phase_y_rad double, phase_z_rad double")
    found = sweeps.sweep(d, (8, 12))
    rows = {(r["sample_id"], r["resolution"]): r for r in sweeps.summaries(found).collect()}
    assert set(rows) == {(s, n) for s in "pg" for n in (8, 12)}
    for (_, n), r in rows.items():
        assert r["solid_voxels"] == pytest.approx(n**3 * (0.3 if r["sample_id"] == "p" else 0.35), rel=0.15) and 0 < r["skeleton_voxels"] < r["solid_voxels"]
        assert r["simplified_nodes"] <= r["raw_branch_nodes"] and r["components"] >= 1
    nodes = sweeps.structural_nodes(found[12], 12)
    assert nodes.count() == found[12].nodes.count() and nodes.filter("x_norm between 0 and 1 and z_norm between 0 and 1 and dist_to_bottom >= 0").count() == nodes.count()
    assert sweeps.changes(sweeps.summaries(found)).select("comparison").distinct().first()[0] == "8->12"
    assert sweeps.length_quantiles(found).count() == 4
    e = found[12].edges
    assert graphs.degrees(found[12].nodes.drop("degree"), e).join(found[12].nodes.select("sample_id", "node", F.col("degree").alias("was")), ["sample_id", "node"]).filter("degree <> was").count() == 0
