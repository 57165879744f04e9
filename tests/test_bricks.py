"""Masks and graphs taken brick by brick, many to a lot: the same results whatever the bricks, and no rounds for what is small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import bricks, kernels
from meshwright.operators import components, geometry, graphs, skeletons, surfaces, sweeps
from test_skeletons import VOXELS, back, pieces, table


def masks():
    rng = np.random.default_rng(5)
    out = {f"m{k}": rng.random((9, 7, 10)) < 0.05 + 0.15 * k for k in range(5)}
    out["line"] = np.zeros((40, 3, 3), dtype=bool)
    out["line"][:, 1, 1] = True
    return out


def moved(spark, m):
    return table(spark, m).withColumns({"i": F.col("i") - 9, "k": F.col("k") + 100})


def writes(monkeypatch, module):
    names, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


def test_small_masks_are_thinned_at_once(spark, monkeypatch):
    names = writes(monkeypatch, skeletons)
    m = {f"s{k}": np.ones((11, 9 + k, 9), dtype=bool) for k in range(3)}
    got = back(skeletons.thinned(table(spark, m)), m)
    assert names.count("thin") == 2  # what is given, and what is left
    large = back(skeletons.thinned(table(spark, m), brick=8), m)
    assert all((got[k] == large[k]).all() for k in m)


def test_lots_of_boxes(monkeypatch):
    monkeypatch.setattr(bricks, "CELLS", 200)
    rng = np.random.default_rng(1)
    slot, at = rng.integers(0, 9, 60), rng.integers(-5, 6, (60, 3))
    seen = []
    for x in bricks.boxes(slot, at):
        box, place = x.where(x.p)
        assert (place == at[x.rows]).all() and (slot[x.head][box] == slot[x.rows]).all() and x.p.max() < x.size
        seen += x.rows.tolist()
    assert sorted(seen) == list(range(60)) and list(bricks.boxes(slot[:0], at[:0])) == []


@pytest.mark.parametrize("brick", [4, 32])
def test_labels_across_bricks(spark, monkeypatch, brick):
    names = writes(monkeypatch, components)
    m = masks()
    for connectivity, within in ((6, 1), (26, 3)):
        want = {(name, min((i * 64 + j) * 64 + k for i, j, k in p)): len(p) for name, v in m.items() for p in pieces(map(tuple, np.argwhere(v)), within)}
        got = geometry.labelled(moved(spark, m), connectivity, brick).groupBy("sample_id", "root").count().collect()
        assert {(r["sample_id"], r["root"]): r["count"] for r in got} == want
    assert not names  # no rounds over all tasks
    assert geometry.labelled(spark.createDataFrame([], VOXELS)).count() == 0


def test_large_graphs_go_by_rounds(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", n) for n in range(12)] + [("b", n) for n in range(4)] + [(None, 1), (None, 2)], "sample_id string, node bigint")
    edges = spark.createDataFrame([("a", n + 1, n) for n in range(8)] + [("b", 3, 1), (None, 1, 2), ("b", 0, None)], "sample_id string, source bigint, target bigint")
    want = {("a", n): n if n > 8 else 0 for n in range(12)} | {("b", n): 1 if n == 3 else n for n in range(4)} | {(None, 1): 1, (None, 2): 1}
    for most, rounds in ((200_000, False), (5, True)):  # more links than that and a graph isn't taken whole
        monkeypatch.setattr(graphs, "WHOLE", most)
        names = writes(monkeypatch, components)
        assert {(r["sample_id"], r["node"]): r["root"] for r in graphs.components(nodes, edges).collect()} == want
        assert bool(names) == rounds


@pytest.mark.parametrize("brick", [3, 32])
def test_surfaces_are_counted_where_they_are_made(spark, capsys, brick):
    m = masks()
    df = moved(spark, m)
    f = surfaces.isosurface(df, brick).cache()
    p = surfaces.vertices(f)
    got = {r["sample_id"]: r for r in surfaces.surface_counts(df, brick).collect()}
    for r in geometry.surface_measures(f, p).join(f.groupBy("sample_id").agg(F.count(F.lit(1)).alias("faces")), "sample_id").join(p.groupBy("sample_id").agg(F.count(F.lit(1)).alias("vertices")), "sample_id").collect():
        for c in ("vertices", "faces", "edges", "watertight", "winding_consistent"):
            assert got[r["sample_id"]][c] == r[c], (r["sample_id"], c)
    surfaces.surface_counts(df, brick).explain()
    assert "Join" not in capsys.readouterr().out  # corners aren't joined to triangles


@pytest.mark.parametrize("brick", [3, 32])
def test_euler_across_bricks(spark, brick):
    m = masks()
    want = {}
    for name, v in m.items():
        cells = {tuple(2 * p + s) for p in np.argwhere(v) for s in np.array(list(np.ndindex(3, 3, 3))) - 1}
        want[name] = sum(1 if sum(c % 2 for c in cell) % 2 else -1 for cell in cells)
    assert {r["sample_id"]: r["euler"] for r in skeletons.euler(moved(spark, m), brick).collect()} == want


def test_open_and_twisted_edges_are_seen(monkeypatch):
    import pyarrow as pa

    one = pa.table({"sample_id": ["s"], "i": [0], "j": [0], "k": [0], "bi": [0], "bj": [0], "bk": [0]})
    counts = lambda: {k: v[0] for k, v in surfaces._counted(one, 32).to_pydict().items()}
    whole = counts()
    assert (whole["vertices"], whole["faces"], whole["edges"], whole["unclosed"], whole["twisted"]) == (6, 8, 12, 0, 0)
    table, begins = surfaces._table()
    torn, turned = table.copy(), table.copy()
    torn[begins[1]], turned[begins[1]] = torn[begins[1]][0], turned[begins[1]][::-1]
    monkeypatch.setattr(surfaces, "_table", lambda: (turned, begins))
    assert counts()["twisted"] == 3 and counts()["unclosed"] == 0
    monkeypatch.setattr(surfaces, "_table", lambda: (torn, begins))
    assert counts()["unclosed"] > 0


def test_distances_of_small_and_large_grids(spark):
    rng = np.random.default_rng(3)
    grids = {"small": rng.random((6, 5, 7)) < 0.8, "other": rng.random((6, 5, 7)) < 0.6, "full": np.ones((3, 3, 3), dtype=bool), "long": rng.random((20, 3, 4)) < 0.9}
    rows = [(n, *map(int, p), bool(v)) for n, g in grids.items() for p, v in np.ndenumerate(g) for p in [(p[0] - 2, p[1] + 40, p[2])]]
    df = spark.createDataFrame(rows, "sample_id string, i int, j int, k int, solid boolean")
    for brick in (8, 64):  # in one brick, or not: by lots, or by lines
        for r in kernels.distance_transform(df, brick).collect():
            g, p = grids[r["sample_id"]], (r["i"] + 2, r["j"] - 40, r["k"])
            empty = np.argwhere(~g)
            want = np.inf if not len(empty) else np.sqrt(((empty - p) ** 2).sum(axis=1).min())
            assert r["distance"] == pytest.approx(want), (brick, r)


def test_surface_lengths_need_no_joins(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("triangles' corners are joined in")

    monkeypatch.setattr(geometry, "with_corners", refused)
    monkeypatch.setattr(geometry, "face_edges", refused)
    solid = spark.createDataFrame([("s", 0, 4, 4, k) for k in range(6)], VOXELS)
    nodes = spark.createDataFrame([("s", n, 0.0, 0.0, z, 1) for n, z in enumerate((0.5, 1.9, 2.3))], "sample_id string, node bigint, x double, y double, z double, degree int")
    got = {r["node"]: r for r in sweeps.structural_nodes(sweeps.Analysis(solid, None, nodes, None, None), 20).collect()}
    # edges are 1 or the root of a half long, so two of them never reach over 2
    assert got[0]["dist_to_bottom"] == pytest.approx(0.5) and (got[0]["bottom_flag"], got[2]["bottom_flag"]) == (1, 0)
