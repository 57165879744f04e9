"""Smallest eigenvalues of graphs' normalised Laplacians, for graphs of any size.

A graph of at most ``dense`` nodes is solved as a matrix. The spectrum of a larger one is the union of its components', of
which small ones are solved so too. The null vector, roots of the degrees, is known and projected away.

A large component is cut into tiles of nodes with neighbouring numbers. Nodes with a link to a later tile are its border. Where
the border is small, the component goes by inverse iteration: each step solves the Laplacian, moved by ``SHIFT``, for a block of
vectors. Tiles eliminate their inner nodes, the border's matrix is solved by one task for each component, and tiles go back; only
what concerns the border and Gram matrices travel, and a few steps do, however small the eigenvalues are.

Other large components go by block iteration on the normalised adjacency (LOBPCG, Knyazev 2001): a product with the adjacency
is a join with the edges and a sum, and only Gram matrices of a block's size meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators import graphs
from meshwright.operators.ordering import positioned
from meshwright.shared import new_path, remove, written

GROUP = ["sample_id", "root"]
TILE = [*GROUP, "slab"]
#: Vectors beside the wanted ones, which make the last wanted ones converge.
GUARD = 4
#: What is added to the Laplacian before it is solved; nodes of a tile whose inner ones are eliminated.
SHIFT, BLOCK = 1e-8, 512
#: Links that one task holds, and entries of the tiles' parts of a border's matrix.
LINKS, ENTRIES = 1 << 20, 1 << 22
#: The residual at which an inverse iteration ends is this share of the value, if that is less than the tolerance.
SHARE = 1e-3
VALUES = "sample_id string, root bigint, value double, bound double"


def _dense(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["source", "target"]].to_numpy(), return_inverse=True)
        s, t = at.reshape(-1, 2).T
        a = np.zeros((len(ids), len(ids)))
        a[s, t] = 1
        d = 1 / np.sqrt(a.sum(0))
        values = np.linalg.eigvalsh(np.eye(len(ids)) - d[:, None] * a * d)
        values = values[values > 1e-9][:k]  # the least one that isn't zero is over 1 / (nodes x degrees)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "root": pdf["root"].iloc[0], "value": values, "bound": 0.0})

    return solve


def ritz(g: np.ndarray, h: np.ndarray, b: int) -> np.ndarray:
    """Coefficients of the best ``b`` vectors, and of the ways to them, in the span of [null, vectors, ways, residuals].

    ``g`` and ``h`` are that basis' products with itself and with its image; the null vector is projected away, columns are
    brought to length 1, and directions that the others hold already are left out. Also the vectors' values.
    """
    n = len(g)
    t = np.vstack([-g[0, 1:] / g[0, 0], np.eye(n - 1)])
    gg, hh = t.T @ g @ t, t.T @ h @ t
    size = np.sqrt(np.maximum(np.diag(gg), 0))
    scale = np.where(size > 1e-13, 1 / np.maximum(size, 1e-300), 0)
    lam, v = np.linalg.eigh(scale[:, None] * gg * scale)
    v = v[:, lam > 1e-9] / np.sqrt(lam[lam > 1e-9])
    small = v.T @ (scale[:, None] * hh * scale) @ v
    values, u = np.linalg.eigh((small + small.T) / 2)
    values, u = values[::-1][:b], u[:, ::-1][:, :b]
    c = scale[:, None] * (v @ u)
    way = c.copy()
    way[:b] = 0
    out = np.zeros((n, 2 * b))
    out[:, : c.shape[1]], out[:, b : b + c.shape[1]] = t @ c, t @ way
    return np.vstack([out, np.pad(values, (0, 2 * b - len(values)))])


def _solver(k: int, b: int, tolerance: float):
    n = 1 + 3 * b

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, h = np.sum([np.frombuffer(x, dtype=np.float64) for x in pdf["gram"]], axis=0).reshape(2, n, n)
        x, r = np.diag(g)[1 : 1 + k], np.sqrt(np.maximum(np.diag(g)[1 + 2 * b : 1 + 2 * b + k], 0))
        had = bool((x > 0.5).all())  # before the first step there are no vectors, only residuals
        values = 1 - np.diag(h)[1 : 1 + k] / np.where(x > 0, x, 1)
        c = ritz(g, (h + h.T) / 2, b)
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "root": [pdf["root"].iloc[0]], "done": [had and bool((r <= tolerance).all())], "values": [values], "bounds": [r], "c": [c.tobytes()]})

    return solve


def _laid(nodes: DataFrame, tile: int) -> DataFrame:
    """Nodes with the tile that holds them and their place in it; a tile has about ``tile`` nodes of one component."""
    slab = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile))
    w = Window.partitionBy(*TILE).orderBy("node")
    return nodes.withColumn("slab", slab.cast("bigint")).withColumn("at", (F.row_number().over(w) - 1).cast("int"))


def _noise(nodes: np.ndarray, b: int) -> np.ndarray:
    """Vectors made of the nodes' numbers, the same in every attempt of a task."""
    v = nodes.astype(np.uint64)[:, None] * np.uint64(b) + np.arange(1, b + 1, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # SplitMix64
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return v / 2.0**63 - 1


def _started(b: int):
    """Tiles whose residuals are noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, a = [], []
            for nodes in batch.column("nodes"):
                r = _noise(nodes.values.to_numpy(), b)
                s.append(np.hstack([np.zeros((len(r), 2 * b)), r]).tobytes())
                a.append(np.zeros((len(r), 2 * b)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.binary()), pa.array(a, pa.binary())], [*batch.schema.names, "s", "a"])

    return run


def _residuals(b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes = batch.column("nodes")[i].values
                r = np.frombuffer(batch.column("s")[i].as_py(), dtype=np.float64).reshape(-1, 3 * b)[:, 2 * b :]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(r).ravel()), b).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("sample_id")[i], len(nodes)), nodes, lists], ["sample_id", "near", "r"])

    return run


def _grams(b: int):
    """Tiles with the image of their residuals, and a row for each component of a task with its summed Gram matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            images = []
            for i in range(batch.num_rows):
                z = batch.column("z")[i].values.to_numpy()[:, None]
                s = np.frombuffer(batch.column("s")[i].as_py(), dtype=np.float64).reshape(-1, 3 * b)
                a = np.frombuffer(batch.column("a")[i].as_py(), dtype=np.float64).reshape(-1, 2 * b)
                got = batch.column("image")[i].values
                m = np.zeros((len(z), b))
                m[got.field("at").to_numpy()] = got.field("m").flatten().to_numpy().reshape(-1, b)
                left, right = np.hstack([z, s]), np.hstack([z, a, m])
                key = (batch.column("sample_id")[i].as_py(), batch.column("root")[i].as_py())
                sums[key] = sums.get(key, 0) + np.stack([left.T @ left, left.T @ right])
                images.append(right[:, 1:].tobytes())
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*TILE, "nodes", "z", "s")], pa.array(images, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], [*TILE, "nodes", "z", "s", "a", "gram"])
            schema = out.schema
            yield out
        for key, gram in sums.items():
            of = dict(zip(GROUP, key, strict=True)) | {"gram": gram.tobytes()}
            yield pa.RecordBatch.from_pylist([of], schema=schema)

    return run


def _turned(b: int):
    """Tiles with the new vectors, ways and residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new_s, new_a = [], []
            for i in range(batch.num_rows):
                z = batch.column("z")[i].values.to_numpy()[:, None]
                s, a = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.float64).reshape(-1, 3 * b) for c in "sa")
                c = np.frombuffer(batch.column("c")[i].as_py(), dtype=np.float64).reshape(-1, 2 * b)
                c, values = c[:-1], c[-1, :b]
                x, image = np.hstack([z, s]) @ c, np.hstack([z, a]) @ c
                new_s.append(np.hstack([x, image[:, :b] - x[:, :b] * values]).tobytes())
                new_a.append(image.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*TILE, "nodes", "z")], pa.array(new_s, pa.binary()), pa.array(new_a, pa.binary())], [*TILE, "nodes", "z", "s", "a"])

    return run


_TILES = "sample_id string, root bigint, slab bigint, nodes array<bigint>, z array<double>"


def _iterated(pairs: DataFrame, nodes: DataFrame, k: int, tile: int, steps: int, tolerance: float) -> list[DataFrame]:
    """Values of components by block iteration; those that converge leave, and no step's tables outlive the next."""
    spark, b = nodes.sparkSession, k + GUARD
    at = written(_laid(nodes, tile), "spectrum-nodes")
    ends = lambda c: at.select("sample_id", F.col("node").alias(c), F.col("degree").alias(f"_{c}"))
    place = at.select("sample_id", *TILE[1:], "at", F.col("node").alias("source"), F.col("degree").alias("_source"))
    adjacency = pairs.join(place, ["sample_id", "source"]).join(ends("target"), ["sample_id", "target"])
    adjacency = written(adjacency.select(*TILE, "at", F.col("target").alias("near"), (1 / F.sqrt(F.col("_source") * F.col("_target"))).alias("w")), "spectrum-edges")
    first = at.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("at", "node", F.sqrt("degree").alias("z")))).alias("t")).select(*TILE, F.col("t.node").alias("nodes"), F.col("t.z").alias("z"))
    kept: list[str] = []

    def saved(df: DataFrame, name: str) -> DataFrame:
        kept.append(new_path(spark, name))
        df.write.parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    tiles, out = saved(first.mapInArrow(_started(b), f"{_TILES}, s binary, a binary"), "spectrum-tiles"), []
    for step in range(steps + 1):
        old, kept = kept, []
        r = tiles.select("sample_id", "nodes", "s").mapInArrow(_residuals(b), "sample_id string, near bigint, r array<double>")
        image = adjacency.join(r, ["sample_id", "near"]).groupBy(*TILE, "at").agg(F.array(*[F.sum(F.col("w") * F.get("r", F.lit(j))) for j in range(b)]).alias("m"))
        image = image.groupBy(*TILE).agg(F.collect_list(F.struct("at", "m")).alias("image"))
        full = saved(tiles.join(image, TILE).mapInArrow(_grams(b), f"{_TILES}, s binary, a binary, gram binary"), "spectrum-images")
        solved = full.filter("gram is not null").select(*GROUP, "gram").groupBy(*GROUP).applyInPandas(_solver(k, b, tolerance), "sample_id string, root bigint, done boolean, values array<double>, bounds array<double>, c binary")
        if step == steps:
            solved = solved.withColumn("done", F.lit(True))
        turn = saved(solved, "spectrum-turns")
        ended, left = turn.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if ended:
            out.append(written(turn.filter("done").select(*GROUP, F.explode(F.arrays_zip("values", "bounds")).alias("v")).select(*GROUP, F.col("v.values").alias("value"), F.col("v.bounds").alias("bound")), "spectrum-values"))
        if left:
            own = full.filter("gram is null").join(turn.filter(~F.col("done")).select(*GROUP, "c"), GROUP)
            tiles = saved(own.mapInArrow(_turned(b), f"{_TILES}, s binary, a binary"), "spectrum-tiles")
            remove(spark, *old, *kept[:-1])
            kept = kept[-1:]
        else:
            remove(spark, *old, *kept)
            break
    return out


def lowest(g: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients over [null, Y] of ``b`` vectors, the first ones of the least values, their values and residuals.

    ``g`` is the Gram matrix of [null, X, Y], where Y solves the moved Laplacian for X, so the Laplacian takes Y to X - SHIFT x Y.
    Directions that the others hold already have no value; what is left of them, rounding, comes last and stands in for noise.
    """
    p = g[1:, 1:] - np.outer(g[1:, 0], g[0, 1:]) / g[0, 0]
    xx, xy, yy = p[:b, :b], p[:b, b:], p[b:, b:]
    scale = 1 / np.sqrt(np.maximum(np.diag(yy), 1e-300))
    lam, v = np.linalg.eigh(scale[:, None] * yy * scale)
    v = scale[:, None] * v / np.sqrt(np.maximum(lam, 1e-16))
    good = v[:, lam > 1e-12]
    h = good.T @ xy @ good
    moved, u = np.linalg.eigh((h + h.T) / 2)
    c = good @ u
    left = np.einsum("ij,ij->j", c, xx @ c) - 2 * moved * np.einsum("ij,ij->j", c, xy @ c) + moved**2 * np.einsum("ij,ij->j", c, yy @ c)
    c = np.hstack([c, v[:, lam <= 1e-12]])
    return np.vstack([-(g[0, 1 + b :] @ c) / g[0, 0], c]), moved - SHIFT, np.sqrt(np.maximum(left, 0))


def _inner(b: int, first: bool):
    """Tiles with the block that solves the moved Laplacian for the last one, and what the border needs to know of it.

    ``told``: the Gram matrix of [null, X, Y], then what eliminating inner nodes adds to [null, Y] at the border. ``part``: what it adds to the border's matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c) for c in batch.schema.names}
            ys, told, parts = [], [], []
            for i in range(batch.num_rows):
                source, target, w, out = (of[c][i].values.to_numpy(zero_copy_only=False) for c in ("source", "target", "w", "outer"))
                nodes, at, s = np.unique(source, return_index=True, return_inverse=True)
                z = np.sqrt(of["degree"][i].values.to_numpy()[at])[:, None]
                border, t = np.unique(target[out], return_inverse=True)
                m, n = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), len(border)))
                m[s[~out], np.searchsorted(nodes, target[~out])] = -w[~out]
                m[np.diag_indices(len(nodes))] += 1 + SHIFT
                n[s[out], t] = -w[out]
                if first:
                    y = _noise(nodes, b)
                    x = np.zeros_like(y)
                    parts.append(-(n.T @ np.linalg.solve(m, n)).ravel())
                else:
                    x = np.hstack([z, of["y"][i].values.to_numpy().reshape(-1, b)]) @ of["c"][i].values.to_numpy().reshape(-1, b)
                    y = np.linalg.solve(m, x - n @ of["u"][i].values.to_numpy().reshape(-1, b))
                    parts.append(None)
                v = np.hstack([z, x, y])
                ahead = -(n.T @ np.linalg.solve(m, np.hstack([z, y])))
                ys.append(y.ravel())
                told.append(np.concatenate([(v.T @ v).ravel(), ahead.ravel()]))
            lists = [pa.array(a, pa.list_(pa.float64())) for a in (ys, told, parts)]
            yield pa.RecordBatch.from_arrays([*[of[c] for c in (*TILE, *_LINKS)], *lists], [*TILE, *_LINKS, "y", "told", "part"])

    return run


_LINKS = ["source", "target", "w", "outer", "degree"]
_INNER = "sample_id string, root bigint, slab bigint, source array<bigint>, target array<bigint>, w array<double>, outer array<boolean>, degree array<double>, y array<double>, told array<double>, part array<double>"
#: Rows of a border: its nodes with roots of degrees, its links, tiles' parts of its matrix, what tiles tell, and its vectors X and Y.
NODES, EDGES, PART, TOLD, STATE = range(5)
_BORDER = "sample_id string, root bigint, slab bigint, kind int, ids array<bigint>, too array<bigint>, v array<double>"
_TURN = "sample_id string, root bigint, slab bigint, done boolean, values array<double>, bounds array<double>, c array<double>, u array<double>, v array<double>"


def _border(k: int, b: int, last: bool, tolerance: float):
    """For one component: the values so far, the next block at its border, and a row for each tile with what it needs of it."""

    def solve(t: pa.Table) -> pa.Table:
        rows: dict[int, list] = {kind: [] for kind in range(5)}
        for i, kind in enumerate(t.column("kind").to_pylist()):
            part = [t.column(c)[i] for c in ("slab", "ids", "too", "v")]
            rows[kind].append([part[0].as_py(), *[x.values.to_numpy() if x.is_valid else None for x in part[1:]]])
        ids, z = (np.concatenate([r[j] for r in rows[NODES]] or [np.zeros(0, ty)]) for j, ty in ((1, np.int64), (3, float)))
        order = np.argsort(ids)
        ids, z = ids[order], z[order][:, None]
        m = np.zeros((len(ids), len(ids)))
        for _, s, e, w in rows[EDGES]:
            m[np.searchsorted(ids, s), np.searchsorted(ids, e)] = -w
        m[np.diag_indices(len(ids))] += 1 + SHIFT
        places = {}
        for slab, own, _, part in rows[PART]:
            at = places[slab] = np.searchsorted(ids, own)
            m[np.ix_(at, at)] += part.reshape(len(at), len(at))
        first = not rows[STATE]
        x, y = (np.zeros((len(ids), b)), _noise(ids, b)) if first else rows[STATE][0][3].reshape(2, -1, b)
        v, ahead, size = np.hstack([z, x, y]), np.zeros((len(ids), 1 + b)), (1 + 2 * b) ** 2
        gram = v.T @ v
        for slab, _, _, told in rows[TOLD]:
            gram += told[:size].reshape(1 + 2 * b, -1)
            ahead[places[slab]] += told[size:].reshape(-1, 1 + b)
        if first:
            c, values, bounds, done = np.vstack([-gram[0, 1 + b :] / gram[0, 0], np.eye(b)]), np.zeros(k), np.full(k, 2.0), False
        else:
            c, values, bounds = lowest(gram, b)
            enough = np.maximum(np.minimum(tolerance, SHARE * values), 1e-7 * (values + SHIFT))
            done = last or (len(values) >= k and bool((bounds <= enough)[:k].all()))
        x = np.hstack([z, y]) @ c
        u = np.linalg.solve(m, x + ahead @ c)
        one = lambda slab, **own: {"sample_id": t.column("sample_id")[0].as_py(), "root": t.column("root")[0].as_py(), "slab": slab, "done": done, **own}
        out = [one(None, values=values[:k], bounds=bounds[:k], v=np.concatenate([x.ravel(), u.ravel()]))]
        out += [one(slab, c=c.ravel(), u=u[at].ravel()) for slab, at in places.items()]
        wide = pa.list_(pa.float64())
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[wide] * 5]
        names = ["sample_id", "root", "slab", "done", "values", "bounds", "c", "u", "v"]
        return pa.table({n: pa.array([r.get(n) for r in out], ty) for n, ty in zip(names, types, strict=True)})

    return solve


def _cut(pairs: DataFrame, nodes: DataFrame, block: int, core: int) -> tuple[DataFrame, DataFrame]:
    """Links of large components with the tiles of their ends and which ends are border; and the components whose borders are small."""
    at = positioned(nodes.select(*GROUP, "node", "degree"), GROUP, [F.col("node")], "place")
    at = written(at.withColumn("slab", F.floor(F.col("place") / block).cast("bigint")), "spectrum-places")
    source = at.select(*TILE, F.col("node").alias("source"), "degree")
    target = at.select("sample_id", F.col("node").alias("target"), F.col("slab").alias("_slab"), F.col("degree").alias("_degree"))
    links = pairs.join(source, ["sample_id", "source"]).join(target, ["sample_id", "target"])
    links = written(links.select(*TILE, "source", "target", "degree", "_slab", (1 / F.sqrt(F.col("degree") * F.col("_degree"))).alias("w")), "spectrum-links")
    border = written(links.filter("_slab > slab").select("sample_id", F.col("source").alias("node")).distinct(), "spectrum-border")
    for end, name in (("source", "own"), ("target", "outer")):
        links = links.join(border.select("sample_id", F.col("node").alias(end), F.lit(True).alias(name)), ["sample_id", end], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    links = written(links.drop("_slab"), "spectrum-links")
    tiles = links.groupBy(*TILE).agg(F.count_if(~F.col("own")).alias("inner"), F.count_if(F.col("own") & F.col("outer")).alias("held"), F.countDistinct(F.when(F.col("own"), F.col("source"))).alias("border"), F.countDistinct(F.when(~F.col("own") & F.col("outer"), F.col("target"))).alias("near"))
    size = tiles.groupBy(*GROUP).agg(F.max("inner").alias("inner"), F.sum("held").alias("held"), F.sum("border").alias("border"), F.sum(F.col("near") * F.col("near")).alias("entries"))
    return links, written(size.select(*GROUP, ((F.col("inner") <= LINKS) & (F.col("held") <= LINKS) & (F.col("border") <= core) & (F.col("entries") <= ENTRIES)).alias("small")), "spectrum-sizes")


def _eliminated(links: DataFrame, k: int, steps: int, tolerance: float) -> list[DataFrame]:
    """Values of components by inverse iteration; those that converge leave, and no step's tables outlive the next."""
    spark, b = links.sparkSession, 2 * (k + GUARD)
    kept: list[str] = []

    def saved(df: DataFrame, name: str) -> DataFrame:
        kept.append(new_path(spark, name))
        df.write.parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    tiles = links.filter(~F.col("own")).groupBy(*TILE).agg(F.collect_list(F.struct(*_LINKS)).alias("l"))
    tiles = tiles.select(*TILE, *[F.col(f"l.{c}").alias(c) for c in _LINKS])
    row = lambda kind, ids, too, v, slab="cast(null as bigint)": [*GROUP, F.expr(slab).alias("slab"), F.lit(kind).alias("kind"), F.expr(ids).alias("ids"), F.expr(too).alias("too"), F.expr(v).alias("v")]
    none = "cast(null as array<bigint>)"
    ends = links.filter("own").groupBy(*GROUP, "source").agg(F.sqrt(F.min("degree")).alias("z")).groupBy(*GROUP).agg(F.collect_list(F.struct("source", "z")).alias("l"))
    held = links.filter("own and outer").groupBy(*GROUP).agg(F.collect_list(F.struct("source", "target", "w")).alias("l"))
    tiles = saved(tiles.mapInArrow(_inner(b, True), _INNER), "spectrum-inner")
    near = "array_sort(array_distinct(filter(target, (x, i) -> outer[i])))"
    fixed = ends.select(*row(NODES, "l.source", none, "l.z")).union(held.select(*row(EDGES, "l.source", "l.target", "l.w"))).union(tiles.select(*row(PART, near, none, "part", "slab")))
    fixed, out = written(fixed, "spectrum-fixed"), []
    state = None
    for step in range(steps + 1):
        every = fixed.union(tiles.select(*row(TOLD, none, none, "told", "slab")))
        if state is not None:
            every = every.join(state.select(*GROUP), GROUP, "left_semi").union(state.select(*row(STATE, none, none, "v")))
        turn = saved(every.groupBy(*GROUP).applyInArrow(_border(k, b, step == steps, tolerance), _TURN), "spectrum-turns")
        own = turn.filter("slab is null")
        ended, left = own.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if ended:
            out.append(written(own.filter("done").select(*GROUP, F.explode(F.arrays_zip("values", "bounds")).alias("v")).select(*GROUP, F.col("v.values").alias("value"), F.col("v.bounds").alias("bound")), "spectrum-values"))
        if not left:
            break
        old, kept[:] = kept[:-1], kept[-1:]
        state = own.filter(~F.col("done")).select(*GROUP, "v")
        tiles = saved(tiles.drop("told", "part").join(turn.filter(~F.col("done") & F.col("slab").isNotNull()).select(*TILE, "c", "u"), TILE).mapInArrow(_inner(b, False), _INNER), "spectrum-inner")
        remove(spark, *old)
    remove(spark, *kept)
    return out


def spectral_signature(edges: DataFrame, k: int = 12, dense: int = 400, tile: int = 4096, steps: int = 200, tolerance: float = 1e-5, core: int = 3072) -> DataFrame:
    """The k smallest nonzero eigenvalues of each sample graph's normalised Laplacian: sample_id, rank, value, bound.

    Edges (sample_id, source, target, whole numbers) are taken once and both ways, rows with a null are left out. ``bound`` is 0
    for what was solved as a matrix; else an eigenvalue is no further from ``value`` than it. An iteration ends when no wanted
    vector's residual is over ``tolerance`` (a value's error is about its square over the gap to the next eigenvalues), or after
    ``steps``, with the bound reached. Large components whose borders have at most ``core`` nodes go by inverse iteration, whose
    residuals are also a small share of their values.
    """
    dense = max(dense, 4 * (k + GUARD))  # a block iteration needs more room than its basis
    e = edges.select("sample_id", F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target")).dropna()
    pairs = written(graphs.doubled(e).distinct(), "spectrum-pairs")
    nodes = pairs.groupBy("sample_id", F.col("source").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("degree"))

    def sized(df: DataFrame, by: list[str]) -> DataFrame:
        return written(df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by), "spectrum-nodes")

    def solved(small: DataFrame) -> DataFrame:
        own = pairs.join(small.select(*GROUP, F.col("node").alias("source")), ["sample_id", "source"])
        return own.select(*GROUP, "source", "target").groupBy(*GROUP).applyInPandas(_dense(k), VALUES)

    nodes = sized(nodes, ["sample_id"])
    parts = [solved(nodes.filter(F.col("n") <= dense).withColumn("root", F.lit(0).cast("bigint")))]
    many = nodes.filter(F.col("n") > dense).drop("n")
    if many.limit(1).count():
        own = pairs.join(many.select("sample_id", F.col("node").alias("source")), ["sample_id", "source"], "left_semi")
        many = sized(written(graphs.components(many, own), "spectrum-components"), GROUP)
        parts.append(solved(many.filter(F.col("n") <= dense)))
        large = many.filter(F.col("n") > dense)
        if large.limit(1).count():
            of = lambda nodes: pairs.join(nodes.select("sample_id", F.col("node").alias("source")), ["sample_id", "source"], "left_semi")
            links, sizes = _cut(of(large), large, min(tile, BLOCK), core)
            small = sizes.filter("small").select(*GROUP)
            if small.limit(1).count():
                parts += _eliminated(written(links.join(small, GROUP), "spectrum-links"), k, steps, tolerance)
            rest = large.join(sizes.filter("not small").select(*GROUP), GROUP)
            if rest.limit(1).count():
                parts += _iterated(of(rest), rest, k, tile, steps, tolerance)
    w = Window.partitionBy("sample_id").orderBy("value", "root")
    every = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w))
    return every.filter(F.col("rank") <= k).select("sample_id", F.col("rank").cast("bigint").alias("rank"), "value", "bound")
