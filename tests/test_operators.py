"""Analytic cases and properties of the operators."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import aggregates, kernels, scalars
from meshwright.operators import audit, features, geometry, graphs, mapping, networks, ordering, relational, skeletons, surfaces
from meshwright.operators.components import connected_components
from meshwright.sources import files, reports, sinks


def one(df):
    return df.first()[0]


def test_scalars(spark):
    x = spark.createDataFrame([(1.0, float("nan"), float("inf"), None)], "a double, b double, c double, d double")
    assert x.select(*[scalars.finite(F.col(c)) for c in "abcd"]).first()[:] == (True, False, False, False)
    u = spark.createDataFrame([(3.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double, f double")
    assert one(u.select(scalars.von_mises(*[F.col(c) for c in "abcdef"]))) == pytest.approx(3)
    assert one(u.select(scalars.equivalent_strain(*[F.col(c) for c in "abcdef"]))) == pytest.approx(2)
    p = [(0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, 1)]
    assert one(u.select(scalars.tet_quality([tuple(F.lit(float(v)) for v in q) for q in p]))) == pytest.approx(1)


def test_metric_bundle_of_a_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0)], "k string, y double, p double")
    r = aggregates.metrics_by(df, ["k"], "y", "p").first()
    assert r["pearson_r"] is None and r["r2"] is None and r["nrmse_range"] is None and r["mae"] == 0.5


def test_one_to_one_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    b = spark.createDataFrame([(1, 4)], "k int, w int")
    assert relational.one_to_one(b, a.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="repeat"):
        relational.one_to_one(a, b, ["k"]).collect()


def test_components_of_a_long_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7000), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(50)) and got[7000] == 7000
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_latin_hypercube_fills_every_stratum(spark):
    rows = relational.latin_hypercube(spark.range(20).withColumnRenamed("id", "i"), 20, ["a", "b"]).collect()
    for d in "ab":
        assert sorted(int(r[d] * 20) for r in rows) == list(range(20))


def test_running_best_needs_more_than_the_delta(spark):
    v = [1.0, 0.5, 0.49995, 0.6, 0.2]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(v, 1)], "m string, e int, v double")
    r = relational.running_best(df, ["m"], "e", "v", 1e-4, 10).first()
    assert (r["best_epoch"], r["best"], r["stop_epoch"]) == (5, 0.2, 5)
    r = relational.running_best(df, ["m"], "e", "v", 1e-4, 2).first()
    assert (r["best_epoch"], r["stop_epoch"]) == (2, 4)


def test_knn_grid_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) ** 3
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid bigint, x double, y double, z double")
    got = {(r["qid"], r["rank"]): r["pid"] for r in mapping.knn(pts.filter("pid % 20 = 0").withColumnRenamed("pid", "qid"), pts, 5).collect()}
    for q in range(0, 200, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [got[q, k] for k in range(1, 6)] == sorted(range(200), key=lambda i: (d[i], i))[:5]


def test_idw_lies_between_and_takes_a_hit(spark):
    n = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 1, 0.0), (2, 2, 5.0)], "qid bigint, pid bigint, dist double")
    v = spark.createDataFrame([(1, 10.0), (2, 20.0)], "pid bigint, v double")
    got = {r["qid"]: r["v"] for r in mapping.idw(n, v, ["v"]).collect()}
    assert got[1] == pytest.approx(11) and got[2] == pytest.approx(10)


def graph(spark):
    nodes = spark.createDataFrame([("s", i, float(i), 0.0, 0.0, "junction" if i == 2 else "endpoint", 1) for i in range(5)], "sample_id string, node bigint, x double, y double, z double, kind string, region_voxels bigint")
    edges = spark.createDataFrame([("s", 0, 1, 0.1), ("s", 1, 2, 2.0), ("s", 2, 3, 2.0), ("s", 2, 4, 0.2)], "sample_id string, source bigint, target bigint, path_length double")
    return nodes, edges


def test_contract_and_prune(spark):
    n, e = graphs.contract_short_edges(*graph(spark), 0.15)
    got = {r["node"]: (r["x"], r["kind"]) for r in n.collect()}
    assert got[0] == (0.5, "junction") and len(got) == 4 and e.count() == 3
    n, e = graphs.prune_spurs(*graph(spark), 0.5)
    assert {(r["source"], r["target"]) for r in e.collect()} == {(1, 2), (2, 3)} and n.count() == 3
    again = graphs.prune_spurs(n, e, 0.5)[1]
    assert again.count() == 2
    assert graphs.component_count(*graph(spark)).first()["components"] == 1


def test_distance_transform_and_labels(spark):
    g = spark.range(125).select(F.lit("s").alias("sample_id"), F.floor(F.col("id") / 25).alias("i"), (F.floor(F.col("id") / 5) % 5).alias("j"), (F.col("id") % 5).alias("k"), "id")
    d = kernels.distance_transform(g.withColumn("solid", F.col("id") != 62))
    assert {(r["i"], r["j"], r["k"]): r["distance"] for r in d.collect()}[0, 0, 0] == pytest.approx(np.sqrt(12))
    two = geometry.labelled(g.filter("i in (0, 2)").select(F.lit("s").alias("sample_id"), "id", "i", "j", "k"))
    assert two.select("root").distinct().count() == 2
    assert geometry.voxel_surface(g.select(F.lit("s").alias("sample_id"), "id", "i", "j", "k")).count() == 150


def test_zscore_fits_on_train_only(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (9.0, 5.0)], "a double, b double")
    got = features.zscored(df, df.filter("a < 5"), ["a", "b"]).collect()
    assert [r["a"] for r in got] == [-1.0, 1.0, 7.0] and [r["b"] for r in got] == [0.0] * 3


def test_status_and_gates(spark):
    df = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert one(df.select(audit.status(F.col("a"), F.col("b"), F.array(), F.lit(True), F.lit(False)))) == "INVALID_CONFLICT"
    with pytest.raises(ValueError, match="constraint"):
        audit.require(df)
    audit.require(df.filter("not a"))


def test_report_last_value_wins(spark):
    rows = ["forces for set TOP", "1 1.0 2.0D+00 3.0", "1 4.0 5.0 6.0", "bad", "stresses", "7 1 1 2 3 4 5 6"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "file string, line int, text string")
    got = {(r["section"], r["id"]): r["values"] for r in reports.records(df).collect()}
    assert got == {("reaction", 1): [4.0, 5.0, 6.0], ("stress", 7): [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}


def test_deck_round_trip(spark):
    deck = reports.deck_set(spark.range(40), "NSET", "TOP").withColumn("file", F.lit("d"))
    assert sorted(r["id"] for r in reports.id_set(deck, "NSET", "TOP").collect()) == list(range(1, 41))


def test_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3), y=np.array([np.nan]))
    (tmp_path / "b.npz").write_bytes(b"no archive")
    got = {r["key"]: r for r in files.npz(spark, str(tmp_path)).collect()}
    assert got["x"]["shape"] == [2, 3] and got["x"]["values"] == list(range(6)) and got["y"]["finite"] is False and got[None]["error"]
    assert {r["ok"] for r in files.npz_probe(spark, str(tmp_path)).collect()} == {True, False}
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("m/a.txt", "hi")
        z.writestr("../out.txt", "no")
    (tmp_path / "c.zip").write_bytes(b.getvalue())
    assert {r["member"]: r["ok"] for r in files.zip_members(spark, str(tmp_path)).collect()} == {"m/a.txt": True, "../out.txt": False}


def test_verified_write_and_ledger(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("sample_id"), F.col("id").alias("v"))
    assert sinks.verified_write(df, str(tmp_path / "w")).count() == 10
    rows = df.select("sample_id", F.lit("fea").alias("stage"), F.when(F.col("v") < 4, "SUCCESS").otherwise("FAILURE").alias("status"), F.lit("").alias("message"))
    sinks.append_ledger(rows, str(tmp_path / "l"))
    assert sinks.pending(df.select("sample_id"), sinks.latest(spark, str(tmp_path / "l")), "fea").count() == 6


def test_positions_and_quantiles_of_hot_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None, int(rng.integers(0, 40)), i) for i in range(400)] + [("one", 7, 900)]
    df = spark.createDataFrame(rows, "k string, v int, i bigint")
    got = ordering.positioned(df, ["k"], [F.col("v"), F.col("i")], "at", "n").collect()
    for k in ("hot", None, "one"):
        want = sorted((v, i) for g, v, i in rows if g == k)
        assert sorted((r["v"], r["i"], r["at"], r["n"]) for r in got if r["k"] == k) == [(*x, at, len(want)) for at, x in enumerate(want)]
    at = (0.0, 0.01, 0.5, 0.777, 1.0)
    q = {r["k"]: r["q"] for r in ordering.quantiles(df, ["k"], ["v"], at).collect()}
    for k in ("hot", None, "one"):
        assert q[k] == pytest.approx(np.quantile([v for g, v, _ in rows if g == k], at))
    assert ordering.quantiles(df.limit(0), ["k"], ["v"], at).count() == 0


def test_neighbours_far_beyond_a_cell(spark, monkeypatch):
    monkeypatch.setattr(mapping, "CELL", 8)
    rng = np.random.default_rng(6)
    p = np.concatenate((rng.random((60, 3)), rng.random((5, 3)) + 500, [[-4000.0, 0, 0]]))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid bigint, x double, y double, z double")
    queries = [(0, 0.5, 0.5, 0.5), (1, 499.0, 500.0, 501.0), (2, 30000.0, 0.0, 0.0), (3, -4000.0, 0.0, 0.0)]
    got = mapping.knn(spark.createDataFrame(queries, "qid bigint, x double, y double, z double"), points, 7).collect()
    for qid, *x in queries:
        d = np.sqrt(((p - x) ** 2).sum(1))
        want = sorted(zip(d, range(len(p)), strict=True))[:7]
        assert [r["pid"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == [i for _, i in want]
    few = mapping.knn(spark.createDataFrame(queries, "qid bigint, x double, y double, z double"), points.limit(3), 7)
    assert few.groupBy("qid").count().filter("count = 3").count() == 4
    assert mapping.knn(spark.createDataFrame(queries, "qid bigint, x double, y double, z double"), points.limit(0), 7).count() == 0


def test_neighbours_where_most_points_lie_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(mapping, "CELL", 16)
    rng = np.random.default_rng(4)
    p = np.concatenate((rng.random((1800, 3)) * 1e-3, rng.random((200, 3)), np.full((1200, 3), 0.25)))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid bigint, x double, y double, z double")
    queries = points.filter("pid % 40 = 0").withColumnRenamed("pid", "qid")
    rows = mapping.knn(queries, points, 9).collect()
    got = {(r["qid"], r["rank"]): r["pid"] for r in rows}
    assert len(rows) == 9 * 80
    for q in range(0, len(p), 40):
        d = np.sqrt(((p - p[q]) ** 2).sum(1))
        want = np.lexsort((np.arange(len(p)), d))[:9]
        assert [got[q, k + 1] for k in range(9)] == want.tolist() or sorted(d[[got[q, k + 1] for k in range(9)]]) == pytest.approx(sorted(d[want]), abs=1e-15)
    tree = mapping.split(p, 6)
    assert np.bincount(tree.of(p[:2000]), minlength=64).max() < 120  # dense places have cells of their own


def test_voxels_of_surfaces(spark):
    g = np.indices((12, 12, 12)) - 5.5
    mask = [("ball", *map(int, c)) for c in np.argwhere((g**2).sum(0) < 25)]
    ball = surfaces.isosurface(spark.createDataFrame(mask, "sample_id string, i bigint, j bigint, k bigint"))
    got = geometry.voxelised(ball, surfaces.vertices(ball), 1.0, (0.0, 0.0, 0.0))
    assert sorted(tuple(r) for r in got.select("sample_id", "i", "j", "k").collect()) == sorted(mask)  # around voxels, and back
    fine = geometry.voxelised(ball, surfaces.vertices(ball), 0.25, (0.0, 0.0, 0.0)).count()
    assert fine / 64 == pytest.approx(geometry.surface_measures(ball, surfaces.vertices(ball)).first()["volume"], rel=0.01)
    # a cube whose sides run through columns of centres, and one that is turned
    corners = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    c, s = np.cos(0.4), np.sin(0.4)
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    places = {"even": np.array(corners) * 4 + 0.5, "turned": (np.array(corners) * 6) @ turn.T}
    points = spark.createDataFrame([(n, k, *map(float, x)) for n, p in places.items() for k, x in enumerate(p)], "sample_id string, nid bigint, x double, y double, z double")
    f = spark.createDataFrame([(n, *t) for n in places for t in faces], "sample_id string, a bigint, b bigint, c bigint")
    got = {}
    for r in geometry.voxelised(f, points, 1.0, (0.0, 0.0, 0.0)).collect():
        got.setdefault(r["sample_id"], set()).add((r["i"], r["j"], r["k"]))
    assert len({(i, j) for i, j, _ in got["even"]}) == 16  # of 5 x 5 columns on its sides, each side takes its own once
    centres = np.stack(np.meshgrid(*[np.arange(-10, 14)] * 3, indexing="ij"), -1).reshape(-1, 3)
    inside = (np.abs((centres + 0.5) @ turn - 3) < 3).all(axis=1)
    assert got["turned"] == {tuple(map(int, v)) for v in centres[inside]}


def test_canonical_graph_and_convergence(spark):
    # a square with a short edge, a parallel edge, a loop and a spur
    xyz = {0: (0, 0), 1: (4, 0), 2: (4, 4), 3: (0, 4), 4: (0.1, 0), 5: (4, 4.4)}
    nodes = spark.createDataFrame([("a", 10 * n, float(x), float(y), 0.0, "junction", 1) for n, (x, y) in xyz.items()], "sample_id string, node bigint, x double, y double, z double, kind string, region_voxels bigint")
    edges = [(4, 1, 4.0), (1, 2, 4.0), (2, 3, 4.0), (3, 0, 4.0), (0, 4, 0.1), (2, 1, 5.0), (1, 1, 3.0), (2, 5, 0.45)]
    e = spark.createDataFrame([("a", 10 * s, 10 * t, w, 1.0) for s, t, w in edges], "sample_id string, source bigint, target bigint, path_length double, local_thickness_mean double")
    n, c, raw = graphs.canonical(nodes, e)
    assert raw.first()[1:] == (6, 6, 1.0)
    got = {r["node"]: (round(r["x"], 6), r["y"], r["degree"]) for r in n.collect()}
    assert got == {0: (0.05, 0, 2), 1: (4, 0, 2), 2: (4, 4, 2), 3: (0, 4, 2)}
    assert {(r["source"], r["target"]) for r in c.collect()} == {(0, 1), (1, 2), (2, 3), (0, 3)}
    r = graphs.summary(n, c).first()
    assert (r["simplified_nodes"], r["simplified_edges"], r["components"], r["endpoint_count"]) == (4, 4, 1, 0)


def test_junction_regions_of_a_cross(spark):
    voxels = [(x, 0, 0) for x in range(5)] + [(2, 1, 0), (2, 2, 0)] + [(9, 9, 9)]
    m = spark.createDataFrame([("s", k, *map(int, v)) for k, v in enumerate(voxels)], "sample_id string, id bigint, i bigint, j bigint, k bigint")
    got = sorted((r["kind"], r["region_voxels"]) for r in skeletons.regions(skeletons.region_voxels(m, geometry.adjacent(m, 6))).collect())
    assert got == [("endpoint", 1)] * 3 + [("isolated", 1), ("junction", 1)]
    sweep = {r["connectivity"]: (r["voxels"], r["pairs"], r["components"]) for r in geometry.connectivity_sweep(m).collect()}
    assert sweep == {6: (8, 6, 2), 18: (8, 8, 2), 26: (8, 8, 2)}


def test_sum_block_equals_numpy(spark):
    rng = np.random.default_rng(3)
    h, e, ends = rng.random((4, 3)), rng.random((5, 3)), [(0, 1), (1, 2), (2, 0), (3, 1), (1, 0)]
    layers = lambda n: [(rng.normal(size=(n, 3)).tolist(), rng.normal(size=3).tolist()), (rng.normal(size=(3, 3)).tolist(), rng.normal(size=3).tolist())]
    edge, node = layers(9), layers(6)

    def net(x, layers):
        for w, b in layers:
            x = np.maximum(x @ np.array(w) + b, 0)
        return (x - x.mean()) / np.sqrt(x.var() + 1e-5)

    nodes = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(h)], "sample_id string, node bigint, h array<double>")
    edges = spark.createDataFrame([("s", a, b, x.tolist()) for (a, b), x in zip(ends, e, strict=True)], "sample_id string, source bigint, target bigint, attr array<double>")
    n, out = networks.sum_block(nodes, edges, edge, node)
    got = {r["node"]: r["h"] for r in n.collect()}
    for i in range(4):
        m = sum((net(np.concatenate((h[t], h[s], x)), edge) for (s, t), x in zip(ends, e, strict=True) if t == i), np.zeros(3))
        assert got[i] == pytest.approx(h[i] + net(np.concatenate((m, h[i])), node))
    got = {(r["source"], r["target"]): r["attr"] for r in out.collect()}
    for (s, t), x in zip(ends, e, strict=True):
        assert got[s, t] == pytest.approx(x + net(np.concatenate((h[s], h[t], x)), edge))


def test_more_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.npy(spark, str(tmp_path)).collect()}
    assert got["a.npy"]["shape"] == [2, 3] and got["a.npy"]["values"] == list(range(6)) and got["bad.npy"]["error"]
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    assert [(r["ok"], r["member"]) for r in files.zip_members(spark, str(tmp_path)).collect()] == [(False, None)]
    (tmp_path / "t.stl").write_text("solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid t\n")
    assert sorted((r["x"], r["y"], r["z"]) for r in files.stl(spark, str(tmp_path)).collect()) == [(0, 0, 0), (0, 1, 0), (1, 0, 0)]
    for root in ("one", "two/deep"):
        (tmp_path / root).mkdir(parents=True)
        (tmp_path / root / "metadata.json").write_text("{}")
    r = files.found(spark, "metadata.json", str(tmp_path / "two"), str(tmp_path)).collect()
    assert len(r) == 2 and {x["place"]: x["path"].rsplit("/", 2)[1] for x in r} == {1: "deep", 2: "one"}
    assert {x["folder"].rsplit("/", 1)[1]: x["missing"] for x in files.missing_markers(spark, str(tmp_path), ["metadata.json", "SUCCESS.txt"]).collect()} == {"one": ["SUCCESS.txt"], "deep": ["SUCCESS.txt"]}


def test_writes_are_verified_in_every_mode(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i bigint, s string")
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        assert sinks.verified_write(df, path, mode=mode).count() == n
    lines = spark.createDataFrame([(k, f"line {k}") for k in range(20, 0, -1)], "line bigint, text string")
    sinks.ordered_text(lines, ["line"], str(tmp_path / "deck"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "deck").glob("part-*")))
    assert text.split("\n")[:-1] == [f"line {k}" for k in range(1, 21)]


def test_a_plan_that_is_not_repeatable_is_written_once(spark, tmp_path):
    df = spark.range(50).select("id", F.rand().alias("r"))
    assert sinks.verified_write(df, str(tmp_path / "p")).count() == 50
    assert sinks.csv(df.withColumn("s", F.when(F.col("id") % 3 == 0, "a,\"b")), str(tmp_path / "c")).filter("s is null").count() == 33
    assert sinks.verified_write(df.limit(0), str(tmp_path / "none")).count() == 0
    assert sinks.verified_write(df, str(tmp_path / "none"), mode="ignore").count() == 0


def test_a_large_report_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = {"a.dat": [], "b.dat": [" no head 1 2 3", ""]}
    for k in range(6000):
        rows["a.dat"].append(" forces (fx,fy,fz) for set TOP" if k % 2500 == 20 else " stresses (elem, integ.pnt.,sxx..)" if k % 2500 == 1700 else f" {k} 1.5D+00 -2.0E-01 {k % 9}" if k % 11 else "")
    for name, text in rows.items():
        (tmp_path / name).write_text(("\r\n" if name == "b.dat" else "\n").join(text) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = reports.lines(spark, str(tmp_path / "*.dat"))
        assert spark.read.text(str(tmp_path / "a.dat")).rdd.getNumPartitions() > 5
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["text"] for r in df.collect()}
        assert got == {(n, k): v for n, text in rows.items() for k, v in enumerate(text)}
        section, want = None, {}
        for k, v in enumerate(rows["a.dat"]):
            section = "reaction" if "forces" in v else "stress" if "stresses" in v else section
            want[k] = section
        for piece in (1 << 20, 700):
            monkeypatch.setattr(reports, "PIECE", piece)
            assert {r["line"]: r["section"] for r in reports.sections(df).filter("file like '%a.dat'").collect()} == want
        assert reports.sections(df).filter("file like '%b.dat' and section is null").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    deck = spark.createDataFrame([("f", k, t) for k, t in enumerate(["*NODE", "9", "*ELSET, ELSET=EALL", "1, 2,", "3", "*NSET, NSET=TOP", "4"])], "file string, line bigint, text string")
    for piece in (1 << 20, 2):
        monkeypatch.setattr(reports, "PIECE", piece)
        assert sorted(r["id"] for r in reports.id_set(deck, "ELSET", "EALL").collect()) == [1, 2, 3]


def test_samples_and_covers(spark):
    df = spark.range(100)
    a = {r["id"] for r in relational.sampled(df, "id", 10).collect()}
    assert len(a) == 10 and a == {r["id"] for r in relational.sampled(df.repartition(7), "id", 10).collect()}
    assert relational.sampled(df, "id", 500).count() == 100
    assert relational.cover_gate(df, df, "id").first()["exact"] and not relational.cover_gate(df.union(df.limit(1)), df, "id").first()["exact"]


def test_archives_lie_in_few_files(spark, tmp_path):
    """Each sample has its NPZ archive, but not a file; names of any kind, and none, come back."""
    names = [f"s{i}" for i in range(300)] + ["a/b", "x=1", "%", "", "ä ö", None]
    rows = [(n, "u", [2, 3], [float(i + j) for j in range(6)]) for i, n in enumerate(names)] + [(n, "v", [1], [np.nan]) for n in names]
    df = spark.createDataFrame(rows, "sample_id string, name string, shape array<int>, values array<double>").repartition(7)
    sinks.npz_bundles(df, str(tmp_path / "n"), 20_000)
    found = list((tmp_path / "n").glob("part-*"))
    assert 4 < len(found) < 40
    with zipfile.ZipFile(found[0]) as z, np.load(io.BytesIO(z.read(z.namelist()[0]))) as a:
        assert sorted(a.files) == ["u", "v"] and a["u"].shape == (2, 3)
    got = files.npz_bundles(spark, str(tmp_path / "n")).collect()
    assert {(r["sample_id"], tuple(r["values"])) for r in got if r["key"] == "u"} == {(n, tuple(v)) for n, k, _, v in rows if k == "u"}
    assert len(got) == len(rows) and all(r["finite"] == (r["key"] == "u") and r["shape"] == ([2, 3] if r["finite"] else [1]) and not r["error"] for r in got)


def test_a_broken_bundle_is_a_row(spark, tmp_path):
    (tmp_path / "part-0.txt").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "part-1.txt", "w") as z:
        z.writestr("a.npz", b"neither")
    got = files.npz_bundles(spark, str(tmp_path)).collect()
    assert {r["sample_id"] for r in got} == {None, "a"} and all(r["error"] for r in got)


def test_round_trip_writes_few_files(spark, sf, tmp_path, monkeypatch):
    from meshwright.plans import rules

    monkeypatch.setattr(rules, "new_path", lambda *_: str(tmp_path / "n"))
    rules.catalog.QUERIES["npz_round_trip"](spark, sf).count()
    assert len(list((tmp_path / "n").rglob("part-*"))) <= 8
