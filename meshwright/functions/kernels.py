"""Per-sample numerics that columns can't express, each a small numpy step inside a grouped Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meshwright.functions import bricks
from meshwright.shared import written


#: Stands for no distance at all; squares of grids' sizes stay exact beside it.
_FAR = 1e15


def envelope(d: np.ndarray) -> np.ndarray:
    """For each row of squared distances, the least of d[p] + (q - p)^2 over all places p, at every place q.

    The lower envelope of parabolas (Felzenszwalb and Huttenlocher), for all rows at once: each place is put on a row's
    stack once and taken off at most once, so the work is linear in a row.
    """
    m, n = d.shape
    rows, top = np.arange(m), np.zeros(m, dtype=np.int64)
    of, start = np.zeros((m, n), dtype=np.int64), np.full((m, n + 1), np.inf)
    start[:, 0] = -np.inf
    for q in range(1, n):
        left, meet = rows, np.empty(m)
        while len(left):
            p = of[left, top[left]]
            meet[left] = (d[left, q] + q * q - d[left, p] - p * p) / (2 * (q - p))
            left = left[meet[left] <= start[left, top[left]]]
            top[left] -= 1
        top += 1
        of[rows, top], start[rows, top], start[rows, top + 1] = q, meet, np.inf
    out, top = np.empty_like(d), np.zeros(m, dtype=np.int64)
    for q in range(n):
        left = rows
        while len(left := left[start[left, top[left] + 1] < q]):
            top[left] += 1
        p = of[rows, top]
        out[:, q] = d[rows, p] + (q - p) ** 2
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a grid (squared distances along one axis), each value the least over its line, farther by the square of the way."""
    for b in batches:
        column = b.column(b.num_columns - 1)
        sizes, flat = np.asarray(column.value_lengths()), np.minimum(column.flatten().to_numpy(), _FAR)
        ends = np.cumsum(sizes)
        for n in np.unique(sizes):
            of = np.flatnonzero(sizes == n)
            best = envelope(flat[(ends[of] - n)[:, None] + np.arange(n)])
            lines = pa.FixedSizeListArray.from_arrays(pa.array(np.where(best >= _FAR / 2, np.inf, best).ravel()), int(n)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(of)) for c in b.columns[:-1]], lines], b.schema.names)


def _grids(t: pa.Table) -> pa.Table:
    """Distances over the whole grids of a lot: those of equal sizes are one array, whose lines are taken along each axis."""
    at, far = bricks.places(t), np.empty(len(t))
    d = np.where(t.column("solid").to_numpy(), _FAR, 0.0)
    for x in bricks.boxes(bricks.slots(t), at):
        flat = np.full(x.size, _FAR)
        flat[x.p] = d[x.rows]
        for dims in np.unique(x.dims, axis=0):
            boxes = x.begins[(x.dims == dims).all(axis=1)]
            cells = (boxes[:, None] + np.arange(dims.prod())).reshape(-1, *dims)[:, 1:-1, 1:-1, 1:-1]
            grids = flat[cells]
            for axis in (1, 2, 3):
                lines = np.moveaxis(grids, axis, -1)
                grids = np.moveaxis(envelope(np.minimum(lines, _FAR).reshape(-1, lines.shape[-1])).reshape(lines.shape), -1, axis)
            flat[cells] = grids
        far[x.rows] = flat[x.p]
    return t.select(["sample_id", "i", "j", "k"]).append_column("distance", pa.array(np.sqrt(np.where(far >= _FAR / 2, np.inf, far))))


def distance_transform(grid: DataFrame, brick: int = bricks.BRICK) -> DataFrame:
    """Distance (in voxels) of each solid voxel to the nearest empty one: rows (sample_id, i, j, k, solid) of whole grids.

    Exact and separable: three passes, each over the lines of one axis. Grids that lie in one brick are taken many to a task, and their
    lines passed at once; of larger ones, a task holds lines and never a grid.
    """
    g = grid.select("sample_id", *[F.col(c).cast("bigint").alias(c) for c in "ijk"], F.coalesce("solid", F.lit(False)).alias("solid"))
    g = written(g.withColumns({b: bricks.brick_of(c, brick) for c, b in zip("ijk", bricks.KEYS, strict=True)}), "distance-grids")
    volume = reduce(lambda a, b: a * b, [F.max(c) - F.min(c) + 1 for c in "ijk"])
    one = reduce(lambda a, b: a & b, [F.min(b) == F.max(b) for b in bricks.KEYS])
    large = written(g.groupBy("sample_id").agg((one & (F.count(F.lit(1)) == volume)).alias("one")).filter("not one").select("sample_id"), "distance-large")
    schema = StructType([*g.schema.fields[:4], StructField("distance", DoubleType())])
    if large.isEmpty():
        return bricks.in_lots(g, g.count(), _grids, schema)
    small = g.hint("merge").join(large, "sample_id", "left_anti")
    return bricks.in_lots(small, g.count(), _grids, schema).unionByName(_by_lines(g.hint("merge").join(large, "sample_id", "left_semi")))


def _by_lines(grid: DataFrame) -> DataFrame:
    d = grid.select("sample_id", *"ijk", F.when(F.col("solid"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("d"))
    for axis in "ijk":
        others = [c for c in "ijk" if c != axis]
        line = d.groupBy("sample_id", *others).agg(F.array_sort(F.collect_list(F.struct(axis, "d"))).alias("x"))
        line = line.select("sample_id", *others, F.transform("x", lambda v: v[axis]).alias(axis), F.transform("x", lambda v: v["d"]).alias("d"))  # noqa: B023
        line = line.mapInArrow(_lines, line.schema)
        d = line.select("sample_id", *others, F.explode(F.arrays_zip(axis, "d")).alias("x")).select("sample_id", *others, f"x.{axis}", "x.d")
    return d.select("sample_id", "i", "j", "k", F.sqrt("d").alias("distance"))
