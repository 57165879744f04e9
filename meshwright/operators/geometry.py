"""Voxel grids, masks, tetrahedra and triangles as tables.

Spark takes exploded rows, and tables of voxels that compress well, for far smaller than they are: their joins are
merged, so that none is broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from meshwright.functions import bricks
from meshwright.functions.scalars import clip, cross, grading, minus, norm, tet_edge_ratio, tet_quality, tet_volume, tpms_of, turns
from meshwright.operators.graphs import components
from meshwright.operators.ordering import positioned
from meshwright.shared import tasks, written

SIDE, ORIGIN = 20.0, (-10.0, -10.0, 0.0)
#: Rows of some numbers for each sample that are broadcast, at most.
BROADCAST_ROWS = 500_000
#: Bins of a threshold's unit, by which values are counted.
BINS = 16


def voxels(df: DataFrame, n: int) -> DataFrame:
    """Each row of ``df`` over the n^3 voxels of the cube: its columns with id, i, j, k and the centres x, y, z.

    Slices are dealt out before they are filled, so that a row's grid is made in parallel.
    """
    line = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    v = df.withColumn("i", F.explode(line)).repartition(tasks(df.sparkSession), *[F.col(c) for c in (*df.columns[:1], "i")]).withColumn("j", F.explode(line)).withColumn("k", F.explode(line))
    at = [(F.lit(o) + (F.col(c) + 0.5) * (SIDE / n)).alias(a) for a, c, o in zip("xyz", "ijk", ORIGIN, strict=True)]
    return v.select("*", ((F.col("i") * n + F.col("j")) * n + F.col("k")).alias("id"), *at)


def field(designs: DataFrame, n: int) -> DataFrame:
    """The implicit field of each design over an n^3 grid, and its threshold profile.

    Angles, then their sines and cosines, are columns first: each is made once a voxel, and what Spark generates stays short enough to be compiled.
    """
    df = voxels(designs, n)
    df = df.withColumns({f"_{a}": turns(F.col(a), F.col("cell_size_mm"), F.col(f"phase_{a}_rad")) for a in "xyz"})
    df = df.withColumns({f"_{name}{a}": wave(f"_{a}") for a in "xyz" for name, wave in (("sin", F.sin), ("cos", F.cos))})
    f = tpms_of(F.col("architecture"), *[(F.col(f"_sin{a}"), F.col(f"_cos{a}")) for a in "xyz"])
    profile = clip(1 + F.col("grading_amplitude") * grading(F.col("grading_mode"), F.col("z") / SIDE), 0.2)
    return df.withColumns({"f": f, "profile": profile}).drop(*[f"_{name}{a}" for a in "xyz" for name in ("", "sin", "cos")])


def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what a written table has for their keys: it is broadcast behind a count, and never the rows."""
    return rows.join(F.broadcast(few), keys) if few.count() <= BROADCAST_ROWS else rows.hint("merge").join(few, keys)


def masked(fields: DataFrame) -> DataFrame:
    """The voxels of fields with ``tau``, their sample's calibrated threshold, and ``solid``: within it, times the profile."""
    f = beside(fields, written(calibrated(fields), "thresholds"), ["sample_id"])
    return f.withColumn("solid", F.abs("f") / F.col("profile") <= F.col("tau") + 1e-9)


def calibrated(fields: DataFrame) -> DataFrame:
    """The threshold at which each sample's mask has its target density: that quantile of |f| over the profile, exactly.

    Values are counted by bins first. Then only those of the bin, or two, around the quantile's place travel, and are put in order.
    NULL and NaN have no bin. (They aren't filtered, nor bins matched by key: Spark would take the whole formula into
    the filter, several times, and what it generates would be too long to be compiled.)
    """
    keys = ["sample_id", "target_relative_density"]
    ratio = fields.select(*keys, (F.abs("f") / F.col("profile")).alias("ratio"))
    ratio = ratio.withColumn("bin", F.when(~F.isnan("ratio"), F.floor(F.col("ratio") * BINS)))
    whole = Window.partitionBy(*keys)
    before = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = ratio.groupBy(*keys, "bin").agg(F.count("bin").alias("n"))
    bins = bins.withColumns({"before": F.coalesce(before, F.lit(0)), "place": F.col("target_relative_density") * (F.sum("n").over(whole) - 1)})
    low, high = F.floor("place"), F.ceil("place")
    bins = bins.filter((F.col("before") <= high) & (F.col("before") + F.col("n") > low))
    bins = written(bins.groupBy(*keys, "place").agg(F.min("before").alias("first"), F.min("bin").alias("one"), F.max("bin").alias("two")), "field-bins")
    near = beside(ratio, bins, keys).filter((F.col("bin") == F.col("one")) | (F.col("bin") == F.col("two")))
    near = positioned(near.drop("bin", "one", "two"), keys, [F.col("ratio")])
    at = F.col("first") + F.col("position")
    share = F.when((at == low) & (low == high), 1.0).when(at == low, high - F.col("place")).when(at == high, F.col("place") - low)
    return near.withColumn("share", share).filter("share is not null").groupBy(*keys).agg(F.sum(F.col("ratio") * F.col("share")).alias("tau")).select("sample_id", "tau")


def boundary_contact(mask: DataFrame, n: int) -> DataFrame:
    """Whether each sample's mask touches each face of the cube."""
    return mask.groupBy("sample_id").agg(*[F.bool_or(F.col(c) == v).alias(f"touch_{a}{side}") for a, c in zip("xyz", "ijk", strict=True) for side, v in (("min", 0), ("max", n - 1))])


#: Columns of a tile's side: a triangle is dealt to tiles first, then to the columns of each.
TILE = 16


def voxelised(faces: DataFrame, points: DataFrame, pitch: float, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    """The voxels (sample_id, i, j, k) whose centres lie inside closed surfaces: faces (sample_id, a, b, c) with points (sample_id, nid, x, y, z).

    Along each column of voxel centres, crossings with triangles are sorted, and what lies between the first and second, third and
    fourth, and so on, is inside. A column through an edge belongs to one of the two triangles there: both see
    the edge from the same end, and it counts for the one that it runs down on, or along to the left.
    """
    t = with_corners(faces, points, ["a", "b", "c"])
    cell = lambda v, o: (v - F.lit(o)) / pitch - 0.5  # noqa: E731  # in columns
    for axis, (name, o) in enumerate(zip("xy", origin[:2], strict=True)):
        v = [F.col(f"p{n}{name}") for n in range(3)]
        t = t.withColumns({f"_l{axis}": F.ceil(cell(F.least(*v), o) - 1e-9), f"_h{axis}": F.floor(cell(F.greatest(*v), o) + 1e-9)})
    t = t.filter("_l0 <= _h0 and _l1 <= _h1")
    for axis in (0, 1):  # tiles, then columns: no row makes more than a tile's side, or the tiles that it spans
        t = t.withColumn(f"_t{axis}", F.explode(F.sequence(F.floor(F.col(f"_l{axis}") / TILE), F.floor(F.col(f"_h{axis}") / TILE))))
    # triangles are few and small beside the columns that they make, so tiles are dealt out before
    tile = ["sample_id", "_t0", "_t1"]
    t = t.repartition(tasks(t.sparkSession), *tile)
    for axis, c in enumerate("ij"):
        low, high = F.col(f"_t{axis}") * TILE, F.col(f"_t{axis}") * TILE + TILE - 1
        t = t.withColumn(c, F.explode(F.sequence(F.greatest(F.col(f"_l{axis}"), low), F.least(F.col(f"_h{axis}"), high))))
    x, y = F.lit(origin[0]) + (F.col("i") + 0.5) * pitch, F.lit(origin[1]) + (F.col("j") + 0.5) * pitch

    def side(p: int, q: int) -> tuple[Column, Column]:
        """On which side of the edge from p to q a column is (+1, -1), and the area that it spans with it."""
        px, py, qx, qy = (F.col(f"p{n}{a}") for n in (p, q) for a in "xy")
        turned = (px > qx) | ((px == qx) & (py > qy))
        ax, ay, bx, by = F.when(turned, qx).otherwise(px), F.when(turned, qy).otherwise(py), F.when(turned, px).otherwise(qx), F.when(turned, py).otherwise(qy)
        area = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * F.when(turned, -1.0).otherwise(1.0)
        tie = F.when((qy < py) | ((qy == py) & (qx < px)), 1).otherwise(-1)
        return F.when(area > 0, 1).when(area < 0, -1).otherwise(tie), area

    (s0, w0), (s1, w1), (s2, w2) = side(1, 2), side(2, 0), side(0, 1)
    t = t.select(*tile, "i", "j", *[c.alias(n) for c, n in zip((s0, s1, s2, w0, w1, w2), ("s0", "s1", "s2", "w0", "w1", "w2"), strict=True)], "p0z", "p1z", "p2z")
    area = F.col("w0") + F.col("w1") + F.col("w2")
    z = (F.col("w0") * F.col("p0z") + F.col("w1") * F.col("p1z") + F.col("w2") * F.col("p2z")) / area
    # exploded, not filtered: Spark would take the sides' formulas into the filter, several times, and what it generates would be too long to be compiled
    inside = (F.col("s0") == F.col("s1")) & (F.col("s1") == F.col("s2")) & (area != 0)
    t = t.select(*tile, "i", "j", F.explode(F.when(inside, F.array(z)).otherwise(F.array().cast("array<double>"))).alias("z"))
    w = Window.partitionBy(*tile, "i", "j").orderBy("z")  # a column lies in one tile, where its task has it
    t = t.select("sample_id", "i", "j", cell(F.col("z"), origin[2]).alias("from"), cell(F.lead("z").over(w), origin[2]).alias("to"), F.row_number().over(w).alias("n")).filter("n % 2 = 1 and to is not null")
    low, high = F.ceil("from"), F.ceil("to") - 1
    return t.filter(low <= high).select("sample_id", "i", "j", F.explode(F.sequence(low, high)).alias("k"))


def adjacent(mask: DataFrame, connectivity: int = 26, *keep: str) -> DataFrame:
    """Pairs (sample_id, a, b) of neighbouring voxels (sample_id, id, i, j, k), each once: they meet by equi-join.

    Kept, if asked for: ``axes``, along how many of which a pair differs (1: a face is shared, 2: an edge, 3: a corner).
    """
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0) and (connectivity == 26 or abs(a) + abs(b) + abs(c) <= (1 if connectivity == 6 else 2))]
    step = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(o, "abc", strict=True)], F.lit(sum(map(abs, o))).alias("axes")) for o in offsets])
    near = mask.select("sample_id", "id", "i", "j", "k", F.explode(step).alias("o")).select("sample_id", F.col("id").alias("a"), "o.axes", *[(F.col(c) + F.col(f"o.{d}")).alias(c) for c, d in zip("ijk", "abc", strict=True)])
    return near.hint("merge").join(mask.select("sample_id", F.col("id").alias("b"), "i", "j", "k"), ["sample_id", "i", "j", "k"]).select("sample_id", "a", "b", *keep)


def labelled(mask: DataFrame, connectivity: int = 26, brick: int = bricks.BRICK) -> DataFrame:
    """Voxels (sample_id, id, i, j, k) with ``root``, the smallest id of their component in their sample.

    Voxels hang together within bricks first; across bricks, only the voxels on their sides meet, and pieces of bricks are joined up.
    """
    steps = bricks.steps_within(connectivity)
    names = mask.columns

    def label(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        at, slot, ids = bricks.places(t), bricks.slots(t), t.column("id").to_numpy()
        u, v = [], []
        for rows, p, along, size, *_ in bricks.boxes(slot, at):
            here = np.full(size, -1, dtype=np.int64)
            here[p] = rows
            for step in ((0, 0, 0), *steps):
                other = here[p + along @ np.array(step)]
                u.append(rows[other >= 0])
                v.append(other[other >= 0])
        root = bricks.roots(len(ids), np.concatenate(u), np.concatenate(v)) if u else np.arange(0)
        return t.select([*names, *bricks.KEYS]).append_column("root", pa.array(ids[root], type=t.schema.field("id").type))

    rows = mask.select("*", *[bricks.brick_of(c, brick).alias(b) for c, b in zip("ijk", bricks.KEYS, strict=True)])
    local = bricks.in_lots(rows, mask.count(), label, StructType([*rows.schema, StructField("root", mask.schema["id"].dataType)]))
    local = written(local, "labels")
    apart = reduce(lambda a, b: a | b, [F.min(b) < F.max(b) for b in bricks.KEYS])
    many = written(local.groupBy("sample_id").agg(apart.alias("apart")).filter("apart").select("sample_id"), "labels-many")
    if many.isEmpty():
        return local.drop(*bricks.KEYS)
    v = local.hint("merge").join(many, "sample_id", "left_semi").select("sample_id", "i", "j", "k", *bricks.KEYS, "root")
    out = reduce(lambda a, b: a | b, [bricks.brick_of(f"_{c}", brick) != F.col(b) for c, b in zip("ijk", bricks.KEYS, strict=True)])
    step = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(n) for x, n in zip(o, "abc", strict=True)]) for o in steps])
    sides = v.filter(reduce(lambda a, b: a | b, [F.pmod(c, F.lit(brick)).isin(0, brick - 1) for c in "ijk"]))
    to = sides.select("sample_id", *bricks.KEYS, F.col("root").alias("source"), "i", "j", "k", F.explode(step).alias("o"))
    to = to.withColumns({f"_{c}": F.col(c) + F.col(f"o.{d}") for c, d in zip("ijk", "abc", strict=True)}).filter(out).select("sample_id", "source", *[F.col(f"_{c}").alias(c) for c in "ijk"])
    edges = to.hint("merge").join(sides.select("sample_id", "i", "j", "k", F.col("root").alias("target")), ["sample_id", "i", "j", "k"])
    edges = written(edges.select("sample_id", "source", "target").filter("source <> target").distinct(), "labels-links")
    pieces = edges.select("sample_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    to = components(pieces, edges).select("sample_id", F.col("node").alias("root"), F.col("root").alias("_low"))
    return local.hint("merge").join(to, ["sample_id", "root"], "left").select(*names, F.coalesce("_low", "root").alias("root"))


def connectivity_sweep(mask: DataFrame, connectivities: tuple[int, ...] = (6, 18, 26)) -> DataFrame:
    """(sample_id, connectivity, voxels, pairs, components): how the same voxels hang together under each neighbourhood."""
    out = None
    for c in connectivities:
        n = adjacent(mask, c).groupBy("sample_id").agg(F.count(F.lit(1)).alias("pairs"))
        one = labelled(mask, c).groupBy("sample_id").agg(F.count(F.lit(1)).alias("voxels"), F.countDistinct("root").alias("components")).join(n, "sample_id", "left")
        one = one.select("sample_id", F.lit(c).alias("connectivity"), "voxels", F.coalesce("pairs", F.lit(0)).cast("bigint").alias("pairs"), "components")
        out = one if out is None else out.union(one)
    return out


def voxel_surface(mask: DataFrame) -> DataFrame:
    """The faces between solid voxels and what is not: sample_id, id, axis, side. (A smooth isosurface is left to a mesher.)"""
    step = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in range(3) for s in (-1, 1)])
    f = mask.select("sample_id", "id", "i", "j", "k", F.explode(step).alias("d")).select("sample_id", "id", "i", "j", "k", "d.axis", "d.side")
    moved = [(F.col(c) + F.when(F.col("axis") == n, F.col("side")).otherwise(0)).alias(c) for n, c in enumerate("ijk")]
    return f.select("sample_id", "id", "axis", "side", *moved).hint("merge").join(mask.select("sample_id", "i", "j", "k"), ["sample_id", "i", "j", "k"], "left_anti").select("sample_id", "id", "axis", "side")


def with_corners(cells: DataFrame, points: DataFrame, corners: list[str]) -> DataFrame:
    """Cells with the coordinates of their corners: p<n>x, p<n>y, p<n>z."""
    for n, c in enumerate(corners):
        cells = cells.hint("merge").join(points.select("sample_id", F.col("nid").alias(c), *[F.col(a).alias(f"p{n}{a}") for a in "xyz"]), ["sample_id", c])
    return cells


def _points(n: int) -> list[tuple[Column, ...]]:
    return [tuple(F.col(f"p{k}{a}") for a in "xyz") for k in range(n)]


def tet_measures(tets: DataFrame, points: DataFrame) -> DataFrame:
    """eid with volume, quality, edge ratio and centroid of each tetrahedron."""
    p = _points(4)
    centre = [((p[0][a] + p[1][a] + p[2][a] + p[3][a]) / 4).alias(f"c{n}") for a, n in enumerate("xyz")]
    return with_corners(tets, points, ["n0", "n1", "n2", "n3"]).select("sample_id", "eid", tet_volume(*p).alias("volume"), tet_quality(p).alias("quality"), tet_edge_ratio(p).alias("edge_ratio"), *centre)


def exterior_faces(tets: DataFrame) -> DataFrame:
    """Faces that belong to one tetrahedron only, their corners as wound there."""
    sides = [("n0", "n2", "n1"), ("n0", "n1", "n3"), ("n1", "n2", "n3"), ("n2", "n0", "n3")]
    faces = tets.select("sample_id", F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c")) for a, b, c in sides])).alias("f"))
    key = F.array_sort(F.array("f.a", "f.b", "f.c"))
    return faces.groupBy("sample_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f")).filter("n = 1").select("sample_id", "f.a", "f.b", "f.c")


def end_sets(tets: DataFrame, points: DataFrame, tolerance: float, slope: float = 0.8) -> DataFrame:
    """Nodes of exterior faces at either end in z whose normal points along z: sample_id, end, nid."""
    p = _points(3)
    f = with_corners(exterior_faces(tets), points, ["a", "b", "c"])
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    nz = F.abs(F.try_divide(n[2], norm(*n)))
    cz = (p[0][2] + p[1][2] + p[2][2]) / 3
    ends = points.groupBy("sample_id").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    f = f.join(ends, "sample_id").filter(nz >= slope).withColumn("end", F.when(cz <= F.col("z0") + tolerance, "bottom").when(cz >= F.col("z1") - tolerance, "top")).filter("end is not null")
    return f.select("sample_id", "end", F.explode(F.array("a", "b", "c")).alias("nid")).distinct()


def surface_measures(faces: DataFrame, points: DataFrame) -> DataFrame:
    """Area, volume, whether each edge has two faces, and whether neighbours are wound alike, for each sample."""
    p = _points(3)
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    q = cross(p[1], p[2])
    size = with_corners(faces, points, ["a", "b", "c"]).groupBy("sample_id").agg(F.sum(0.5 * norm(*n)).alias("area"), (F.sum(p[0][0] * q[0] + p[0][1] * q[1] + p[0][2] * q[2]) / 6).alias("volume"))
    d = directed(faces).groupBy("sample_id", "u", "v").agg(F.count(F.lit(1)).alias("m"))
    both = d.groupBy("sample_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("m").alias("n"), F.max("m").alias("m"))
    return size.hint("merge").join(both.groupBy("sample_id").agg(F.bool_and(F.col("n") == 2).alias("watertight"), F.bool_and(F.col("m") == 1).alias("winding_consistent"), F.count(F.lit(1)).alias("edges")), "sample_id")


def directed(faces: DataFrame) -> DataFrame:
    """The edges of faces as they are run through: sample_id, u, v."""
    e = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("sample_id", F.explode(e).alias("e")).select("sample_id", "e.u", "e.v")


def face_edges(faces: DataFrame) -> DataFrame:
    """Directed edges of faces and how often each occurs: sample_id, u, v, m (a row for each occurrence)."""
    d = directed(faces)
    return d.hint("merge").join(d.groupBy("sample_id", "u", "v").agg(F.count(F.lit(1)).alias("m")), ["sample_id", "u", "v"])


def anchors(nodes: DataFrame) -> DataFrame:
    """For each sample, the node nearest to the centroid and the one farthest from that node; ties by number."""
    c = nodes.groupBy("sample_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    near = lambda a, b: (F.col("x") - F.col(a)) * (F.col("x") - F.col(a)) + (F.col("y") - F.col(b)) * (F.col("y") - F.col(b))
    one = nodes.join(c, "sample_id").groupBy("sample_id").agg(F.min(F.struct(near("mx", "my").alias("d"), "nid", "x", "y")).alias("s"))
    one = one.select("sample_id", F.col("s.nid").alias("anchor"), F.col("s.x").alias("ax"), F.col("s.y").alias("ay"))
    two = nodes.join(one, "sample_id").groupBy("sample_id", "anchor").agg(F.min(F.struct((-near("ax", "ay")).alias("d"), "nid")).alias("s"))
    return two.select("sample_id", "anchor", F.col("s.nid").alias("guide"))
