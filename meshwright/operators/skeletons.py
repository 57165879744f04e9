"""Skeletons of voxel masks and the graphs that they draw: thinning, junction regions, branches.

A mask is a table of its solid voxels (sample_id, id, i, j, k). Thinning deals it into bricks with a rim of neighbours, so a
task holds bricks, whatever a sample's size. Branches are traced by pointer jumping: the rounds grow with the logarithm
of the longest branch.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshwright.functions import bricks
from meshwright.operators.geometry import adjacent, beside
from meshwright.operators.graphs import components
from meshwright.shared import written

#: The 26 neighbours of a voxel; bit b of a neighbourhood's code is set if neighbour b is solid.
NEIGHBOURS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
#: Voxels of a brick's rim: a cycle's eight passes look one voxel further each.
RIM = 8


def _joined(pairs: list[list[int]], within: int) -> np.ndarray:
    """For each neighbour, the code of those that it touches: they differ by at most 1 in each axis, and by ``within`` in sum."""
    far = lambda p, q: [abs(a - b) for a, b in zip(p, q, strict=True)]
    return np.array([sum(1 << k for k, q in enumerate(pairs) if q != p and max(far(p, q)) == 1 and sum(far(p, q)) <= within) for p in pairs], dtype=np.uint32)


_SOLID = _joined(NEIGHBOURS, 3)
_EMPTY = _joined(NEIGHBOURS, 1)
_FACES = np.uint32(sum(1 << k for k, p in enumerate(NEIGHBOURS) if sum(map(abs, p)) == 1))
_EDGES = np.uint32(sum(1 << k for k, p in enumerate(NEIGHBOURS) if sum(map(abs, p)) <= 2))


def _grown(seed: np.ndarray, inside: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """The part of ``inside`` that hangs together with ``seed``."""
    out, growing = seed.copy(), np.arange(len(seed))
    while len(growing):
        seed = out[growing]
        more = seed.copy()
        for b, near in enumerate(touching):
            more |= (seed >> np.uint32(b) & np.uint32(1)) * near
        more &= inside[growing]
        out[growing] = more
        growing = growing[more != seed]
    return out


def _lowest(code: np.ndarray) -> np.ndarray:
    return code & (~code + np.uint32(1))


def simple(codes: np.ndarray) -> np.ndarray:
    """Whether a voxel of each neighbourhood code can go without change of topology.

    Its solid neighbours are one piece (of touching voxels), and so are the empty ones that share a face with it (through
    faces, within its 18 neighbours): Bertrand and Malandain's characterisation for 26-connected solids in 6-connected space.
    """
    codes = codes.astype(np.uint32)
    empty = ~codes & _EDGES
    faces = empty & _FACES
    one = _grown(_lowest(codes), codes, _SOLID) == codes
    return one & (codes != 0) & (faces != 0) & ((_grown(_lowest(faces), empty, _EMPTY) & faces) == faces)


def _codes(solid: np.ndarray, p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Neighbourhood codes of the voxels at ``p`` of a flat array with empty margins."""
    out = np.zeros(len(p), dtype=np.uint32)
    for b, step in enumerate(NEIGHBOURS):
        out |= solid[p + steps @ np.array(step)].astype(np.uint32) << np.uint32(b)
    return out


def _cycle(solid: np.ndarray, p: np.ndarray, steps: np.ndarray, field: np.ndarray) -> None:
    """One layer less: of the voxels at ``p`` with an empty face now, those that are simple and no ends go, one subfield after another.

    Voxels of a subfield (equal parities) don't touch, so that all of it can go at once.
    """
    outer = np.zeros(len(p), dtype=bool)
    for step in NEIGHBOURS:
        if sum(map(abs, step)) == 1:
            outer |= ~solid[p + steps @ np.array(step)]
    p, steps, field = p[outer], steps[outer], field[outer]
    for f in range(8):
        of = field == f
        codes = _codes(solid, p[of], steps[of])
        ends = codes & (codes - np.uint32(1)) == 0  # one neighbour, or none
        kinds, to = np.unique(codes, return_inverse=True)
        solid[p[of][simple(kinds)[to] & ~ends]] = False


def _peeled(t: pa.Table) -> pa.Table:
    """A lot's own voxels that stay: bricks that are ``whole`` samples are peeled until nothing goes, others by one cycle."""
    at, slot = bricks.places(t), bricks.slots(t)
    own, whole, stays = t.column("own").to_numpy(), t.column("whole").to_numpy(), np.zeros(len(at), dtype=bool)
    of = np.flatnonzero(np.isin(slot, slot[own]))  # the others are rims without a brick
    for rows, p, steps, size, *_ in bricks.boxes(slot[of], at[of]):
        rows = of[rows]
        solid = np.zeros(size, dtype=bool)
        solid[p] = True
        field, todo = at[rows] % 2 @ np.array([4, 2, 1]), np.arange(len(rows))
        while len(todo):
            _cycle(solid, p[todo], steps[todo], field[todo])
            left = solid[p[todo]]
            again = np.unique(slot[rows[todo[~left]]])
            todo = todo[left & whole[rows[todo]]]
            todo = todo[np.isin(slot[rows[todo]], again)]
        stays[rows] = solid[p]
    return t.filter(pa.array(stays & own)).select(["sample_id", "id", "i", "j", "k"])


def thinned(mask: DataFrame, brick: int = bricks.BRICK, most: int = 1000) -> DataFrame:
    """The skeleton of each sample's mask: voxels (sample_id, id, i, j, k) that remain when no layer can go.

    A sample in one brick is peeled at once, by a task that has many such. Of the others, each cycle takes a layer of all that still
    change, brick by brick: a brick comes with a rim of ``RIM`` voxels, so that its own come out as if the whole grid were one.
    Components, tunnels and cavities stay, and so do ends of curves.
    """
    if brick < RIM:
        raise ValueError(f"a brick must be {RIM} voxels wide at least")
    schema = "sample_id " + mask.schema["sample_id"].dataType.simpleString() + ", id bigint, i bigint, j bigint, k bigint"
    rows = written(mask.select("sample_id", *[F.col(c).cast("bigint").alias(c) for c in ("id", "i", "j", "k")]), "thin")
    whole = reduce(lambda a, b: a & b, [F.min(bricks.brick_of(c, brick)) == F.max(bricks.brick_of(c, brick)) for c in "ijk"])
    before, settled = written(rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), whole.alias("whole")), "thin-sizes"), []
    for _ in range(most):
        near = beside(rows, before, ["sample_id"])
        for c in "ijk":
            b, o = bricks.brick_of(c, brick), F.pmod(F.col(c), F.lit(brick))
            rim = [F.when(~F.col("whole") & (o < RIM), b - 1), F.when(~F.col("whole") & (o >= brick - RIM), b + 1)]
            near = near.withColumn(f"b{c}", F.explode(F.array_compact(F.array(b, *rim))))
        own = reduce(lambda a, b: a & b, [bricks.brick_of(c, brick) == F.col(f"b{c}") for c in "ijk"])
        rows = written(bricks.in_lots(near.drop("n").withColumn("own", own), rows.count(), _peeled, schema), "thin")
        after = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("left"))
        after = written(before.join(after, "sample_id").select("sample_id", F.col("left").alias("n"), "whole", (F.col("whole") | (F.col("n") == F.col("left"))).alias("done")), "thin-sizes")
        before = after.filter("not done").drop("done")
        if before.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(after.filter("done").select("sample_id"), "sample_id", "left_semi"))
        rows = rows.join(before.select("sample_id"), "sample_id", "left_semi")
    else:
        raise RuntimeError(f"masks still change after {most} cycles")
    return reduce(DataFrame.unionByName, settled)


def _eulers(t: pa.Table, side: int) -> pa.Table:
    """Corners - edges + faces - voxels of the cells in each brick of a lot: along an axis, a voxel's cell is 2 c, and odd cells are its ends."""
    at, brick = 2 * bricks.places(t), bricks.places(t, bricks.KEYS)
    heads, sums = [], []
    for x in bricks.boxes(bricks.slots(t), at):
        seen = np.zeros(x.size, dtype=bool)
        for step in product((-1, 0, 1), repeat=3):
            seen[x.p + x.steps @ np.array(step)] = True
        box, cell = x.where(np.flatnonzero(seen))
        own = ((cell + 1) // (2 * side) == brick[x.head][box]).all(axis=1)
        sign = 2 * ((cell % 2).sum(axis=1) % 2) - 1
        heads.append(x.head)
        sums.append(np.bincount(box[own], sign[own], len(x.head)).astype(np.int64))
    return t.select(["sample_id"]).take(pa.array(np.concatenate(heads))).append_column("euler", pa.array(np.concatenate(sums)))


def euler(mask: DataFrame, brick: int = bricks.BRICK) -> DataFrame:
    """(sample_id, euler): corners - edges + faces - voxels of each sample's closed voxels; thinning doesn't change it."""
    schema = StructType([mask.schema["sample_id"], StructField("euler", LongType())])
    parts = bricks.in_lots(bricks.cell_bricks(mask, brick), mask.count(), lambda t: _eulers(t, brick), schema)
    return parts.groupBy("sample_id").agg(F.sum("euler").alias("euler"))


def region_voxels(skeleton: DataFrame, pairs: DataFrame) -> DataFrame:
    """The skeleton's voxels that are graph nodes: its columns with ``node`` and ``kind``.

    ``pairs`` are its touching voxels (sample_id, a, b). Touching voxels of more than two neighbours are one junction, by its
    smallest id; ends and lone voxels are nodes of their own.
    """
    d = pairs.select("sample_id", F.explode(F.array("a", "b")).alias("id")).groupBy("sample_id", "id").agg(F.count(F.lit(1)).alias("d"))
    v = skeleton.join(d, ["sample_id", "id"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    v = written(v.withColumn("kind", F.when(F.col("d") > 2, "junction").when(F.col("d") == 1, "endpoint").when(F.col("d") == 0, "isolated")).filter("kind is not null").drop("d"), "voxel-nodes")
    inside = v.filter("kind = 'junction'").select("sample_id", "id")
    e = pairs.join(inside.withColumnRenamed("id", "a"), ["sample_id", "a"], "left_semi").join(inside.withColumnRenamed("id", "b"), ["sample_id", "b"], "left_semi")
    named = components(v.withColumnRenamed("id", "node"), e.select("sample_id", F.col("a").alias("source"), F.col("b").alias("target")))
    return written(named.withColumnsRenamed({"node": "id", "root": "node"}), "voxel-regions")


def regions(voxels: DataFrame) -> DataFrame:
    """(sample_id, node, kind, region_voxels, i, j, k) of region voxels: each node stands at their mean."""
    return voxels.groupBy("sample_id", "node", "kind").agg(F.count(F.lit(1)).alias("region_voxels"), *[F.avg(c).alias(c) for c in "ijk"])


def branches(skeleton: DataFrame, pairs: DataFrame, voxels: DataFrame, most: int = 60) -> DataFrame:
    """(sample_id, source, target, first, last, steps, thickness_sum, thickness_min, voxel_count): the skeleton's branches.

    ``skeleton`` has ``thickness``; ``voxels`` are its region voxels. A branch leaves a node by one voxel and runs through
    voxels of two neighbours to another node; ``first`` and ``last`` are the nodes' voxels at its ends, ``steps`` the length
    of its way in voxels, and thicknesses are taken over all its voxels, both ends included. A way back to the same node, and
    a ring without nodes, are no branches. Of a branch's two directions, the one from the smaller node stays.

    Every step between touching voxels is an arc, followed by the arc that leaves its end, if that has two neighbours. An
    arc that is followed takes over what its follower has come to, so that ways double each round.
    """
    where = skeleton.select("sample_id", "id", "i", "j", "k", "thickness")
    at = lambda end: where.select("sample_id", F.col("id").alias(end), *[F.col(c).cast("double").alias(f"{end}_{c}") for c in "ijk"], F.col("thickness").alias(f"{end}_t"))
    both = pairs.select("sample_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("sample_id", F.col("p.a").alias("u"), F.col("p.b").alias("v"))
    node = lambda end, to: voxels.select("sample_id", F.col("id").alias(end), F.col("node").alias(to))
    arcs = both.join(at("u"), ["sample_id", "u"]).join(at("v"), ["sample_id", "v"]).join(node("u", "source"), ["sample_id", "u"], "left").join(node("v", "target"), ["sample_id", "v"], "left")
    far = F.sqrt(sum(((F.col(f"u_{c}") - F.col(f"v_{c}")) * (F.col(f"u_{c}") - F.col(f"v_{c}")) for c in "ijk"), F.lit(0.0)))
    arcs = arcs.select("sample_id", "u", "v", "source", "target", "u_t", far.alias("steps"), F.col("v_t").alias("t_sum"), F.col("v_t").alias("t_min"), F.lit(1).cast("bigint").alias("n"))
    arcs = written(arcs.filter("source is null or target is null or source <> target"), "branch-arcs")
    # an arc u, v is followed by v, w: v has two neighbours, and w is the other
    after = arcs.filter("source is null").select("sample_id", F.col("u").alias("v"), F.col("v").alias("w"))
    last = F.when(F.col("target").isNotNull(), F.col("v"))
    arcs = arcs.join(after, ["sample_id", "v"], "left").filter("w is null or w <> u").withColumn("last", last)
    arcs = written(arcs.select("sample_id", "u", "v", "source", "target", "last", "u_t", "steps", "t_sum", "t_min", "n", F.col("v").alias("next_u"), F.col("w").alias("next_v")), "branch-arcs")
    for _ in range(most):
        if arcs.filter("source is not null and target is null").isEmpty():
            break
        held = [F.col(c).alias(f"_{c}") for c in ("target", "last", "steps", "t_sum", "t_min", "n", "next_u", "next_v")]
        ahead = arcs.filter("source is null").select("sample_id", F.col("u").alias("next_u"), F.col("v").alias("next_v"), *held)
        open_ = arcs.filter("target is null").join(ahead, ["sample_id", "next_u", "next_v"])
        open_ = open_.select(
            "sample_id", "u", "v", "source", F.col("_target").alias("target"), F.col("_last").alias("last"), "u_t", (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("t_sum") + F.col("_t_sum")).alias("t_sum"),
            F.least("t_min", "_t_min").alias("t_min"), (F.col("n") + F.col("_n")).alias("n"), F.col("_next_u").alias("next_u"), F.col("_next_v").alias("next_v"),
        )
        arcs = written(arcs.filter("target is not null").unionByName(open_), "branch-arcs")
    else:
        raise RuntimeError(f"branches don't end in {most} rounds")
    return arcs.filter("source < target").select(
        "sample_id", "source", "target", F.col("u").alias("first"), "last", "steps", (F.col("t_sum") + F.col("u_t")).alias("thickness_sum"), F.least("t_min", "u_t").alias("thickness_min"), (F.col("n") + 1).alias("voxel_count")
    )


def graph(skeleton: DataFrame, pitch: float | Column = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), connectivity: int = 26) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a skeleton (with ``thickness`` in voxels) draws, in world units: what ``graphs.canonical`` starts from.

    Nodes: sample_id, node, x, y, z, kind, region_voxels. Edges: source, target, path_length, local_thickness_mean,
    local_thickness_min, voxel_count; parallel ones each have a row.
    """
    pitch = pitch if isinstance(pitch, Column) else F.lit(pitch)
    pairs = written(adjacent(skeleton, connectivity), "skeleton-pairs")
    voxels = region_voxels(skeleton.select("sample_id", "id", "i", "j", "k"), pairs)
    nodes = regions(voxels)
    place = [(F.lit(o) + (F.col(c) + 0.5) * pitch).alias(a) for c, a, o in zip("ijk", "xyz", origin, strict=True)]
    edges = branches(skeleton, pairs, voxels)
    return nodes.select("sample_id", "node", *place, "kind", "region_voxels"), edges.select(
        "sample_id", "source", "target", (F.col("steps") * pitch).alias("path_length"), (F.col("thickness_sum") / F.col("voxel_count") * pitch).alias("local_thickness_mean"), (F.col("thickness_min") * pitch).alias("local_thickness_min"), "voxel_count"
    )
