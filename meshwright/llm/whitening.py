"""Embedding whitening: principal components of unit variance, from two passes of exact and centred sums.

An entry c of a vector becomes the integer floor(64 c) + 1000000. The first pass sums integers, exactly, so that the mean
is the same however rows are dealt out. The second sums outer products of what is centred by that mean, one matrix product
a batch; ``treeAggregate`` merges the tasks' sums, and LAPACK's symmetric solver takes the covariance apart. The
projection (a row for each dimension, a column for each component) is broadcast, and a last pass measures how far the
covariance of what comes out is from the identity.

What a task or the driver holds is one batch and a matrix of dimension x dimension, whatever the rows.

- A vector that is null, or holds a null, NaN or infinite entry, is dropped. Vectors of another length than the most common
  one (of equally common ones, the longest) have no place in the same space and are dropped too.
- Rows may repeat and ids may be null or repeat: every row counts and is returned. Columns other than the two named are not read.
- An empty table, or one without a vector left, gives no rows; so does one whose vectors are empty.
- Entries beyond 2^61 / 64 either way are taken for that value. A deviation that no long holds is null.
- A component without variance (an eigenvalue not above dimension x machine precision x the largest) has no unit scale:
  its whitened values are null, and it takes no part in identity_error. Without any variance, explained is null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table

#: Fixed by the contract: entries are counted in 64ths, and shifted.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Integers beyond this either way are cut to it.
_MOST = 1 << 61
#: Vectors of a block; a block of n vectors gives n x components rows.
_BLOCK = 2048


class Fit(NamedTuple):
    """What rows are projected by: counts and sums of x, and components as columns of unit vectors."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    live: np.ndarray

    def projection(self) -> np.ndarray:
        return self.vectors[:, self.live] / np.sqrt(self.values[self.live])


def _usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows and their vectors as integers."""
    for whole in batches:
        for at in range(0, whole.num_rows, _BLOCK):
            b = whole.slice(at, _BLOCK)
            c = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            yield b, np.clip(np.floor(c * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT


def _total(x: np.ndarray) -> list[int]:
    """Column sums without overflow."""
    small = float(np.abs(x).max(initial=0)) * len(x) < 2**62
    return [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: longs where they suffice, else Python's integers."""
    small = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums)) < 2**62
    return x * n - np.array(sums, dtype=np.int64) if small else x.astype(object) * n - np.array(sums, dtype=object)


def _merged(rows: DataFrame, task, add):
    """One value of what ``task`` makes of each partition's batches, added up in a tree; None where there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = task(batches)
        if got is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(got)], pa.binary())})

    put = lambda a, b: b if a is None else a if b is None else add(a, b)
    return rows.mapInArrow(run, "part binary").rdd.treeAggregate(None, lambda a, r: put(a, pickle.loads(r[0])), put)


def _sums(batches: Iterator[pa.RecordBatch]):
    n, total = 0, None
    for _, x in _blocks(batches):
        n, s = n + len(x), _total(x)
        total = s if total is None else [a + b for a, b in zip(total, s, strict=True)]
    return None if total is None else (n, total)


def _scatter(n: int, sums: list[int], projection=None):
    """A task's sum of outer products of centred vectors; given a broadcast projection, of whitened ones with a 1 at their end."""

    def run(batches: Iterator[pa.RecordBatch]):
        out = None
        for _, x in _blocks(batches):
            y = _spread(x, n, sums).astype(np.float64) / n
            if projection is not None:
                y = np.column_stack([y @ projection.value, np.ones(len(y))])
            out = y.T @ y if out is None else out + y.T @ y
        return out

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the rows' ``vector`` (arrays of one length); None where there are no rows."""
    counted = _merged(rows, _sums, lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))
    if counted is None:
        return None
    n, sums = counted
    covariance = _merged(rows, _scatter(n, sums), np.add) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    live = values > len(values) * np.finfo(float).eps * max(values[0], 0)
    top = vectors[:, :components]
    return Fit(n, sums, top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1.0, 1.0), values[:components], float(np.trace(covariance)), live[:components])


def usable(df: DataFrame, vector: str, keep: str) -> DataFrame:
    """(key, vector) of the rows that can be whitened: finite vectors of the most common length."""
    rows = df.select(F.col(keep).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(_usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter((F.size("vector") == common["d"]) & (F.size("vector") > 0)) if common else rows.limit(0)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error): one for each vector and component."""
    spark = df.sparkSession
    rows = usable(df, vector, key)
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = fit(rows, components)
    if found is None:
        return spark.createDataFrame([], schema)
    n, sums, live = found.n, found.sums, np.flatnonzero(found.live)
    shares = [float(v) / found.trace if found.trace > 0 else None for v in found.values]
    projection = spark.sparkContext.broadcast(found.projection())
    off = 0.0
    if len(live):
        second = _merged(rows, _scatter(n, sums, projection), np.add) / n
        off = float(np.abs(second[:-1, :-1] - np.outer(second[-1, :-1], second[-1, :-1]) - np.eye(len(live))).max())
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            spread = _spread(x, n, sums)
            most = float(np.abs(spread).max(initial=0)) ** 2 * x.shape[1]
            wide = spread if most < 2**62 else spread.astype(object)
            deviation = [int(v) if v < 2**63 else None for v in (wide * wide).sum(axis=1)]
            out = np.full((len(x), k), np.nan)
            out[:, live] = (spread.astype(np.float64) / n) @ projection.value
            size = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, dtype=np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(out.ravel(), mask=np.isnan(out.ravel())),
                    pa.array(shares * len(x), pa.float64()), pa.array(np.full(size, off)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` by its first 32 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
