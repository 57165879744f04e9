"""Nearest neighbours and inverse-distance fields."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.shared import written


#: Points of a cell, about, and cells of a tree at most; a tree is made of so many sampled points for each cell.
CELL, CELLS, SAMPLED = 256, 1 << 14, 16
#: Queries that are held against all cells at once.
_QUERIES = 128


class Cells(NamedTuple):
    """A k-d tree: axis and place of each split (a heap: children of i are 2 i + 1 and 2 i + 2), and levels of splits."""

    axis: np.ndarray
    place: np.ndarray
    depth: int

    def of(self, xyz: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xyz), dtype=np.int64)
        for _ in range(self.depth):
            right = xyz[np.arange(len(xyz)), self.axis[at]] > self.place[at]
            at = 2 * at + 1 + right
        return at - (2**self.depth - 1)


def split(sample: np.ndarray, depth: int) -> Cells:
    """Cells of about equally many of the sampled points: medians along the longest side, level by level."""
    axis, place = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    parts = [sample]
    for level in range(depth):
        following = []
        for k, p in enumerate(parts):
            at = 2**level - 1 + k
            if len(p):
                axis[at] = np.argmax(p.max(axis=0) - p.min(axis=0))
                v = p[:, axis[at]]
                place[at] = np.median(v)
                if place[at] == v.max() > v.min():  # half of them or more are in one place, which has a side of its own
                    place[at] = v[v < v.max()].max()
            right = p[:, axis[at]] > place[at]
            following += [p[~right], p[right]]
        parts = following
    return Cells(axis, place, depth)


def _xyz(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in "xyz"], axis=1)


def knn(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k nearest points of each query in 3-D: (qid, rank, pid, dist), ties by pid. Exact; fewer where there are fewer points.

    ``queries``: qid, x, y, z; ``points``: pid, x, y, z, without nulls. Points lie in the cells of a k-d tree, which is split at
    medians of a sample, so that cells are about as full wherever points lie dense. Each cell's number of points and
    extent say how far a query's k-th neighbour can be at most: the nearest cells that hold k points together, to their
    far corners. A query meets the cells within that, and no other. What is broadcast is the tree and a row for each of ``CELLS`` cells
    at most. Points that no split can part (they are all in one place) are dealt out by hash.
    """
    p = written(points.select("pid", *[F.col(a).cast("double").alias(a) for a in "xyz"]), "knn-points")
    n = p.count()
    depth = min(max(0, math.ceil(math.log2(max(1, n) / CELL))), int(math.log2(CELLS)))
    wanted = SAMPLED << depth
    sample = p if n <= wanted else p.filter(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
    drawn = sample.select("x", "y", "z").toArrow()
    tree = split(np.stack([drawn.column(c).to_numpy() for c in "xyz"], axis=1), depth)
    sc = p.sparkSession.sparkContext
    held = sc.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.of(_xyz(b)))], [*b.schema.names, "cell"])

    kind = points.schema["pid"].dataType.simpleString()
    p = written(p.mapInArrow(placed, f"pid {kind}, x double, y double, z double, cell bigint"), "knn-cells")
    cells = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{m}_{a}") for a in "xyz" for m, f in (("low", F.min), ("high", F.max))]).toArrow()
    of = lambda c: cells.column(c).to_numpy()
    low, high = (np.stack([of(f"{m}_{a}") for a in "xyz"], axis=1) for m in ("low", "high"))
    boxes = sc.broadcast((of("cell"), of("n"), low, high))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, low, high = boxes.value
        for whole in batches:
            for first in range(0, whole.num_rows if len(ids) else 0, _QUERIES):
                b = whole.slice(first, _QUERIES)
                q = _xyz(b)[:, None]
                near = np.sqrt((np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(axis=2))
                far = np.sqrt((np.maximum(np.abs(q - low), np.abs(high - q)) ** 2).sum(axis=2))
                order = np.argsort(far, axis=1)
                enough = np.minimum((np.cumsum(sizes[order], axis=1) < k).sum(axis=1), len(ids) - 1)
                reach = np.take_along_axis(far, order, axis=1)[np.arange(len(q)), enough] * (1 + 1e-12)
                row, cell = np.nonzero(near <= reach[:, None])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns], pa.array(ids[cell]), pa.array(reach[row])], [*b.schema.names, "cell", "reach"])

    kind = queries.schema["qid"].dataType.simpleString()
    asked = queries.select("qid", *[F.col(a).cast("double").alias(a) for a in "xyz"]).mapInArrow(met, f"qid {kind}, x double, y double, z double, cell bigint, reach double")
    largest = int(of("n").max()) if len(cells) else 0
    blocks = -(-largest // (4 * CELL)) if largest > 64 * CELL else 1  # cells that splits couldn't part
    if blocks > 1:
        asked = asked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        p = p.withColumn("_b", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    by = ["cell", "_b"] if blocks > 1 else ["cell"]
    both = asked.join(p.select(*by, "pid", *[F.col(a).alias(f"p{a}") for a in "xyz"]), by)
    d = F.sqrt(sum(((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in "xyz"), F.lit(0.0)))
    near = both.select("qid", "pid", d.alias("dist"), "reach").filter("dist <= reach")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "pid"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", F.col("rank").cast("bigint").alias("rank"), "pid", "dist")


def idw(neighbours: DataFrame, values: DataFrame, columns: list[str], power: float = 2.0, floor: float = 1e-9) -> DataFrame:
    """Inverse-distance weighted fields of each query; ``values``: pid and the columns."""
    w = 1 / F.pow(F.greatest("dist", F.lit(floor)), F.lit(power))
    m = neighbours.join(values, "pid").withColumn("_w", w)
    return m.groupBy("qid").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in columns])
