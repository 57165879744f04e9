"""Voxels dealt into bricks, and bricks into lots: what one numpy step takes, whatever a sample's size.

A lot holds many small bricks or few full ones, so that neither a sample nor a call for each brick makes a task's time. A grid of
a lot is one flat array: each brick has a box in it with an empty margin, and a neighbour is a step along the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.shared import tasks

#: Voxels of a brick's side, of a lot, and cells of a lot's flat array: one brick of either is taken whatever it holds.
BRICK, LOT, CELLS = 32, 200_000, 1 << 25
KEYS = ["bi", "bj", "bk"]


def brick_of(c: str, brick: int = BRICK, ahead: int = 0) -> Column:
    return F.floor((F.col(c) + ahead) / brick)


def lots(df: DataFrame, rows: int) -> int:
    """How many lots ``rows`` voxels make."""
    return max(tasks(df.sparkSession), -(-rows // LOT))


def in_lots(bricks: DataFrame, rows: int, step: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``step`` over lots of voxels (sample_id, bi, bj, bk, ...), each with whole bricks."""
    lot = F.pmod(F.xxhash64("sample_id", *KEYS), F.lit(lots(bricks, rows)))
    return bricks.groupBy(lot.alias("lot")).applyInArrow(step, schema)


def cell_bricks(mask: DataFrame, brick: int = BRICK) -> DataFrame:
    """Voxels (sample_id, i, j, k) in each brick of the cells that they are corners of: the cell between voxels c and c + 1 lies in c + 1's."""
    v = mask.select("sample_id", *[F.col(c).cast("bigint").alias(c) for c in "ijk"])
    for c in "ijk":
        v = v.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(brick_of(c, brick), brick_of(c, brick, 1)))))
    return v


def slots(t: pa.Table) -> np.ndarray:
    """A number from 0 for the brick of each row."""
    keys = t.select(["sample_id", *KEYS]).to_pandas()
    return keys.groupby(["sample_id", *KEYS], sort=False, dropna=False).ngroup().to_numpy()


def places(t: pa.Table, names: Sequence[str] = "ijk") -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names], axis=1)


class Boxes(NamedTuple):
    """The rows of some bricks, where they lie in a flat array of ``size``, a step along each axis there, and of each brick a row and its box."""

    rows: np.ndarray
    p: np.ndarray
    steps: np.ndarray
    size: int
    head: np.ndarray
    begins: np.ndarray
    low: np.ndarray
    dims: np.ndarray

    def where(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places in the array: the number of the box, and the place in the grid."""
        b = np.searchsorted(self.begins, cells, side="right") - 1
        rest, d = cells - self.begins[b], self.dims[b]
        return b, self.low[b] + np.stack([rest // (d[:, 1] * d[:, 2]), rest // d[:, 2] % d[:, 1], rest % d[:, 2]], axis=1)


def boxes(slot: np.ndarray, at: np.ndarray) -> Iterator[Boxes]:
    """Bricks side by side, as many at once as ``CELLS`` allow."""
    order = np.argsort(slot, kind="stable")
    starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
    if not len(starts):
        return
    stops = np.append(starts[1:], len(order))
    low = np.minimum.reduceat(at[order], starts) - 1
    dims = np.maximum.reduceat(at[order], starts) - low + 2
    ends = np.cumsum(dims.prod(axis=1))
    first = 0
    while first < len(starts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
        some = slice(first, last)
        rows = order[starts[first] : stops[last - 1]]
        b = np.repeat(np.arange(last - first), (stops - starts)[some])
        begins, d = np.append(0, ends)[first:last] - done, dims[some][b]
        steps = np.stack([d[:, 1] * d[:, 2], d[:, 2], np.ones(len(b), dtype=np.int64)], axis=1)
        yield Boxes(rows, begins[b] + ((at[rows] - low[some][b]) * steps).sum(axis=1), steps, int(ends[last - 1] - done), order[starts[some]], begins, low[some], dims[some])
        first = last


def steps_within(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the steps to the 6, 18 or 26 neighbours: of a step and its reverse, one."""
    most = {6: 1, 18: 2}.get(connectivity, 3)
    return [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= most]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest that it hangs together with by the links u, v: hooked to lower roots, then shortened."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root
