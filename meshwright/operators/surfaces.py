"""Closed triangle surfaces around voxel masks: marching cubes over bricks of cells, by a table of cases.

A cell has eight voxels as corners. Its code says which are solid; the surface cuts each of its edges between a solid and an
empty corner in the middle. The cases are made by rule, not listed: on each face of a cell, a line goes around every run
of solid corners, with the solid on its right as seen from outside, so that solid corners across a face are kept apart,
and two cells agree on the face that they share. The lines close into polygons, which are cut into triangles without
diagonals in a face. Vertices are known by the sum of their edge's ends, so that cells share them without a search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshwright.functions import bricks
from meshwright.operators.graphs import components

CORNERS = list(product((0, 1), repeat=3))
#: Half voxels that a vertex's number has room for along an axis, and what is added so that none is negative.
_ROOM, _SHIFT = 1 << 20, 1 << 8

Point = tuple[int, int, int]


def _sides() -> list[list[Point]]:
    """The corners of each face of the cell, counterclockwise as seen from outside."""
    out = []
    for axis, side in product(range(3), (0, 1)):
        square = []
        for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):
            c = [0, 0, 0]
            c[axis], c[(axis + 1) % 3], c[(axis + 2) % 3] = side, u, v
            square.append(tuple(c))
        out.append(square if side else square[::-1])
    return out


def _middle(p: Point, q: Point) -> Point:
    return tuple(a + b for a, b in zip(p, q, strict=True))


def _shared_face(p: Point, q: Point) -> bool:
    """Whether two vertices (in half voxels, 0 to 2) lie in one face of the cell."""
    return any(a == b and a != 1 for a, b in zip(p, q, strict=True))


def _cut(polygon: list[Point]) -> list[tuple[Point, Point, Point]] | None:
    """Triangles of a polygon, without diagonals in a face of the cell; None if there are none such."""
    if len(polygon) == 3:
        return [tuple(polygon)]
    n = len(polygon)
    for k in range(n):  # an ear between k - 1, k and k + 1
        a, b, c = polygon[k - 1], polygon[k], polygon[(k + 1) % n]
        if not _shared_face(a, c):
            rest = _cut([p for p in polygon if p != b])
            if rest is not None:
                return [(a, b, c), *rest]
    return None


@cache
def cases() -> dict[int, list[tuple[Point, Point, Point]]]:
    """The triangles of each cell code that has any; bit k of a code is corner k, vertices are sums of an edge's ends."""
    out = {}
    for code in range(256):
        solid = {c for k, c in enumerate(CORNERS) if code >> k & 1}
        follows: dict[Point, Point] = {}
        for square in _sides():
            for k in range(4):
                if square[k] in solid and square[k - 1] not in solid:  # a run of solid corners begins
                    last = k
                    while square[(last + 1) % 4] in solid:
                        last += 1
                    follows[_middle(square[k - 1], square[k])] = _middle(square[last % 4], square[(last + 1) % 4])
        triangles = []
        while follows:
            polygon = [next(iter(follows))]
            while (after := follows.pop(polygon[-1])) != polygon[0]:
                polygon.append(after)
            triangles += _cut(polygon)
        if triangles:
            out[code] = triangles
    return out


@cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    """The triangles of all codes (n, 3 corners, 3 axes), and where each code's begin."""
    of = [cases().get(code, []) for code in range(256)]
    return np.array([t for triangles in of for t in triangles], dtype=np.int64), np.cumsum([0, *map(len, of)])


def _triangles(t: pa.Table, side: int) -> Iterator[tuple[bricks.Boxes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bricks of a lot with the triangles of their own cells: each one's box, its cell's place, and its corners within the cell."""
    at, brick = bricks.places(t), bricks.places(t, bricks.KEYS)
    table, begins = _table()
    for x in bricks.boxes(bricks.slots(t), at):
        codes = np.zeros(x.size, dtype=np.uint8)
        for k, corner in enumerate(CORNERS):
            codes[x.p - x.steps @ np.array(corner)] |= np.uint8(1 << k)
        cells = np.flatnonzero(np.diff(begins)[codes])
        box, cell = x.where(cells)
        own = ((cell + 1) // side == brick[x.head][box]).all(axis=1)
        box, cell, code = box[own], cell[own], codes[cells[own]]
        n = np.diff(begins)[code]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield x, np.repeat(box, n), np.repeat(cell, n, axis=0), table[np.repeat(begins[code], n) + nth]


def _numbers(cell: np.ndarray, corners: np.ndarray) -> np.ndarray:
    h = 2 * cell[:, None, :] + corners + _SHIFT
    return (h[..., 0] * _ROOM + h[..., 1]) * _ROOM + h[..., 2]


def _faces(t: pa.Table, side: int) -> pa.Table:
    rows, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 3), dtype=np.int64)]
    for x, box, cell, corners in _triangles(t, side):
        rows.append(x.head[box])
        numbers.append(_numbers(cell, corners))
    out = t.select(["sample_id"]).take(pa.array(np.concatenate(rows)))
    for c, v in zip("abc", np.concatenate(numbers).T, strict=True):
        out = out.append_column(c, pa.array(np.ascontiguousarray(v)))
    return out


def _over_cells(mask: DataFrame, brick: int, step: Callable[[pa.Table, int], pa.Table], longs: Iterable[str]) -> DataFrame:
    schema = StructType([mask.schema["sample_id"], *[StructField(c, LongType()) for c in longs]])
    return bricks.in_lots(bricks.cell_bricks(mask, brick), mask.count(), lambda t: step(t, brick), schema)


def isosurface(mask: DataFrame, brick: int = bricks.BRICK) -> DataFrame:
    """(sample_id, a, b, c): the triangles around a mask's voxels (sample_id, i, j, k), wound with their normals outward.

    a, b and c number vertices; ``vertices`` gives their places. What lies beyond the voxels is empty, so every surface is closed.
    """
    return _over_cells(mask, brick, _faces, "abc")


_COUNTS = ("vertices", "faces", "edges", "unclosed", "twisted")
_ENDS = ("u", "v", "forward", "back")


def _counted(t: pa.Table, side: int) -> pa.Table:
    """Each brick's own counts (u and v are null), and what lies on its sides, where other bricks may have it too, one by one.

    An edge u < v is run through forward or back by its triangles; a vertex is u = v. An edge is unclosed without two triangles, and
    twisted if two run through it alike.
    """
    heads, counts, shared_heads, shared_rows = [], [], [], []
    for x, box, cell, corners in _triangles(t, side):
        box = np.repeat(box, 3)
        number = _numbers(cell, corners).ravel()
        # vertices by their place in boxes of half voxels, in the order of their numbers, and the sides of the brick that they lie on
        d = 2 * x.dims + 1
        h = (2 * np.repeat(cell, 3, axis=0) + corners.reshape(-1, 3)) - 2 * x.low[box]
        place = (np.cumsum(d.prod(axis=1)) - d.prod(axis=1))[box] + (h[:, 0] * d[box, 1] + h[:, 1]) * d[box, 2] + h[:, 2]
        nth = np.repeat((cell + 1) % side, 3, axis=0)
        sides = ((nth == 0) & (corners.reshape(-1, 3) == 0)) @ np.array([1, 2, 4]) | ((nth == side - 1) & (corners.reshape(-1, 3) == 2)) @ np.array([8, 16, 32])
        after = np.arange(len(box)).reshape(-1, 3)[:, [1, 2, 0]].ravel()  # a corner's next one in its triangle

        places, one, vertex = np.unique(place, return_index=True, return_inverse=True)
        outer = sides[one] > 0
        count = lambda boxes: np.bincount(boxes, minlength=len(x.head))  # noqa: B023, E731
        shared_heads.append(x.head[box[one[outer]]])
        shared_rows.append(np.stack([number[one[outer]], number[one[outer]], *np.zeros((2, outer.sum()), dtype=np.int64)]))

        low, high = np.minimum(vertex, vertex[after]), np.maximum(vertex, vertex[after])
        key = (low * len(places) + high) * 2 + (vertex < vertex[after])
        order = np.argsort(key)
        begin = np.flatnonzero(np.diff(key[order] // 2, prepend=-1))
        n = np.diff(np.append(begin, len(key)))
        forward = np.add.reduceat(key[order] % 2, begin) if len(begin) else n
        edge = order[begin]
        rim = sides[edge] & sides[after[edge]] > 0
        inner = box[edge[~rim]]
        unclosed, twisted = n[~rim] != 2, np.maximum(forward, n - forward)[~rim] > 1
        shared_heads.append(x.head[box[edge[rim]]])
        shared_rows.append(np.stack([number[one[low[edge[rim]]]], number[one[high[edge[rim]]]], forward[rim], (n - forward)[rim]]))

        heads.append(x.head)
        counts.append(np.stack([count(box[one[~outer]]), count(box[::3]), count(inner), count(inner[unclosed]), count(inner[twisted])]))
    sample = t.select(["sample_id"])
    own = sample.take(pa.array(np.concatenate(heads)))
    shared = sample.take(pa.array(np.concatenate(shared_heads)))
    for c, v, w in zip((*_COUNTS, *_ENDS), (*np.concatenate(counts, axis=1), *[None] * 4), (*[None] * 5, *np.concatenate(shared_rows, axis=1)), strict=True):
        own = own.append_column(c, pa.nulls(len(own), pa.int64()) if v is None else pa.array(v))
        shared = shared.append_column(c, pa.nulls(len(shared), pa.int64()) if w is None else pa.array(w))
    return pa.concat_tables([own, shared])


def surface_counts(mask: DataFrame, brick: int = bricks.BRICK) -> DataFrame:
    """(sample_id, vertices, faces, edges, watertight, winding_consistent) of the surface around a mask's voxels.

    Bricks count their triangles' vertices and edges where they make them; only those on their sides meet others by a shuffle.
    """
    one = _over_cells(mask, brick, _counted, (*_COUNTS, *_ENDS)).groupBy("sample_id", "u", "v").agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "forward", "back")])
    here = {"vertices": F.col("u") == F.col("v"), "edges": F.col("u") < F.col("v"), "unclosed": (F.col("u") < F.col("v")) & (F.col("forward") + F.col("back") != 2), "twisted": (F.col("u") < F.col("v")) & (F.greatest("forward", "back") > 1)}
    one = one.select("sample_id", *[F.coalesce(F.col(c), here[c].cast("bigint") if c in here else F.lit(0)).alias(c) for c in _COUNTS])
    s = one.groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in _COUNTS]).filter("faces > 0")
    return s.select("sample_id", "vertices", "faces", "edges", (F.col("unclosed") == 0).alias("watertight"), (F.col("twisted") == 0).alias("winding_consistent"))


def place(nid: str, pitch: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, Column]:
    """x, y, z of a vertex by its number, a voxel's centre being half a pitch inside it."""
    half = [F.floor(F.col(nid) / (_ROOM * _ROOM)), F.floor(F.col(nid) / _ROOM) % _ROOM, F.col(nid) % _ROOM]
    return {a: F.lit(o) + ((h - _SHIFT) / 2 + 0.5) * pitch for a, h, o in zip("xyz", half, origin, strict=True)}


def vertices(faces: DataFrame, pitch: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(sample_id, nid, x, y, z): the places of the vertices that faces use."""
    n = faces.select("sample_id", F.explode(F.array("a", "b", "c")).alias("nid")).distinct()
    return n.withColumns(place("nid", pitch, origin))


def surface_components(faces: DataFrame) -> DataFrame:
    """(sample_id, components): the pieces of each sample's surface, triangles that share a vertex being one."""
    nodes = faces.select("sample_id", F.explode(F.array("a", "b", "c")).alias("node")).distinct()
    edges = faces.select("sample_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("e")).select("sample_id", F.col("e.a").alias("source"), F.col("e.b").alias("target"))
    return components(nodes, edges).groupBy("sample_id").agg(F.countDistinct("root").alias("components"))
