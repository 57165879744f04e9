"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the 0 to ``DEPTH`` bytes before it. All
depths mix Krichevsky-Trofimov estimates: a node's weighted probability is half its own block probability and
half the product of its children's. Counts come from every training text; after training the tree is frozen, so
the probability of a bit mixes, along the path of its context, each depth's estimate by the share of the node's
own block in its weighted probability. A path ends at the deepest context that training met.

The tree is a table that grows with the corpus; no node is left out. A gram is a byte after the ``DEPTH`` bytes
before it. Blocks of documents give their distinct grams, which are summed over all blocks by ranges of their
hashes. Grams that share their last three context bytes build the tree from ``DEPTH`` up to depth 3, and the sums
of its nodes give depths 2 to 0: at most 255 nodes for each of 65,536, 256 and 1 contexts, whatever the corpus, so
tasks hold those. Each gram's log-probability then travels back to the blocks that have it. The word base goes
the same way: a block's distinct words, summed by ranges, and the sums back. So what is shuffled grows with the
distinct grams and words of blocks, not with the bytes.

A null text is empty: one end token, one end byte. Texts are lower-cased A-Z. Rows with a null doc_id are
passed through and count as held out; repeated rows are scored alike. A byte sequence is read in pieces, so a
very long text needs memory for itself and its distinct grams. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import fold, table
from meshwright.shared import written

#: Bytes of context; those that groups share; up to 7 fit with their byte into an integer of 64 bits.
DEPTH, SHARED = 5, 3
FOLDS = 10
BLOCK_BYTES = 16 << 20
ALPHA = 0.1
#: Distinct grams of a group that builds a part of the tree, about.
GROUP = 200_000
_PIECE = 1 << 20
_MASK = np.uint64((1 << 8 * (DEPTH + 1)) - 1)
_END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a line end
_M = np.uint64(0x9E3779B97F4A7C15)
WORDS, GRAMS = 0, 1


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Each byte of a lower-cased text and its end byte 0, after the DEPTH bytes before, in one integer; in pieces."""
    b, n = b"\0" * 7 + text + b"\0", len(text) + 1
    for k in range(0, n, _PIECE):
        yield np.ndarray((min(_PIECE, n - k),), ">u8", b, k, (1,)).astype(np.uint64) & _MASK


def word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a lower-cased text's words, and of its end."""
    ws = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    return np.append(h, np.uint64(_END))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n[order], first) if len(k) else n


class Tally:
    """Distinct keys and how often they are counted."""

    def __init__(self) -> None:
        self.parts: tuple[list, list] = ([], [])
        self.size, self.keys, self.counts = 0, [], []

    def add(self, keys: np.ndarray, counts: bool) -> None:
        """Keys that are counted, or only known."""
        self.parts[counts].append(keys)
        self.size += len(keys)
        if self.size >= 2 * _PIECE:
            self._flush()

    def _flush(self) -> None:
        for counts, p in enumerate(self.parts):
            if p:
                k, n = np.unique(np.concatenate(p), return_counts=True)
                self.keys.append(k)
                self.counts.append(n * counts)
                p.clear()
        self.size = 0
        if len(self.keys) > 16:
            self.keys, self.counts = ([x] for x in merged(self.keys, self.counts))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush()
        return merged(self.keys, self.counts)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: shifted by 8, then Stirling's series."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _nodes(g: np.ndarray, k: int, depth: int) -> np.ndarray:
    """The node that decides bit k of each gram at a depth: its context << 8 | the bits so far with a leading 1."""
    byte = g & np.uint64(255)
    return ((g >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | np.uint64(1 << k) | byte >> np.uint64(8 - k)


def _summed_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and sums of values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)


class Level:
    """The frozen nodes of one depth: keys, estimates, shares of their own blocks, and log weighted probabilities."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, product: np.ndarray | None) -> None:
        """``product``: the sum of the children's log weighted probabilities (none: leaves)."""
        self.key, self.n0, self.n1 = key, n0, n1
        own = _log_kt(n0, n1)
        self.p = (n1 + 0.5) / (n0 + n1 + 1)
        if product is None:
            self.log_w, self.share = own, np.ones(len(key))
        else:
            self.log_w = np.logaddexp(own, product) - math.log(2)
            self.share = np.exp(own - math.log(2) - self.log_w)

    def above(self, depth: int) -> Level:
        """The level of ``depth``, one less than this one's: a child's context has one older byte on top."""
        return Level(*_summed_by(self.key & np.uint64((1 << 8 * depth + 8) - 1), self.n0, self.n1, self.log_w))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are met."""
        if not len(self.key):
            return np.zeros(len(key), np.intp), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def leaves(g: np.ndarray, n: np.ndarray) -> Level:
    """The level of DEPTH, of grams and their counts (above 0)."""
    key = np.concatenate([_nodes(g, k, DEPTH) for k in range(8)])
    one = np.concatenate([(g >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64) for k in range(8)])
    c = np.tile(n.astype(np.float64), 8)
    return Level(*_summed_by(key, c * (1 - one), c * one), None)


def _part(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, Level]:
    """Of grams that are whole groups of their last SHARED context bytes: what DEPTH to SHARED mix, and the level of SHARED.

    The mix is the probability of a one for each of a gram's eight decisions; NaN where training never met the
    context of SHARED bytes. Grams that are not counted are looked up only.
    """
    met = n > 0
    levels = [leaves(g[met], n[met])]
    for depth in range(DEPTH - 1, SHARED - 1, -1):
        levels.append(levels[-1].above(depth))
    mix = np.full((len(g), 8), np.nan)
    for k in range(8):
        for depth, level in zip(range(DEPTH, SHARED - 1, -1), levels, strict=True):
            at, known = level.find(_nodes(g, k, depth))
            if len(level.key):
                p, w = level.p[at], np.where(np.isnan(mix[:, k]), 1.0, level.share[at])
                mix[:, k] = np.where(known, w * p + (1 - w) * np.nan_to_num(mix[:, k]), mix[:, k])
    return mix, levels[-1]


_PART = "g bigint, mix binary, key bigint, n0 double, n1 double, log_w double"


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each gram, and one for each node of depth SHARED."""
    g, n = pdf["g"].to_numpy().astype(np.uint64), pdf["n"].to_numpy()
    ctx = g >> np.uint64(8) & np.uint64((1 << 8 * SHARED) - 1)
    order = np.argsort(ctx, kind="stable")
    g, n, ctx = g[order], n[order], ctx[order]
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    # whole contexts, some GROUP grams at a time
    at = np.unique(np.searchsorted(first, np.arange(GROUP, len(g), GROUP)))
    cuts = first[at[at < len(first)]]
    out = []
    for x, m in zip(np.split(g, cuts), np.split(n, cuts), strict=True):
        mix, level = _part(x, m)
        out.append(pd.DataFrame({"g": x.astype(np.int64), "mix": [r.tobytes() for r in mix.astype(np.float32)]}))
        out.append(pd.DataFrame({"key": level.key.astype(np.int64), "n0": level.n0, "n1": level.n1, "log_w": level.log_w}))
    return pd.concat([x.reindex(columns=["g", "mix", "key", "n0", "n1", "log_w"]) for x in out]).astype({"g": "Int64", "key": "Int64"})


class Shallow:
    """Depths below SHARED: what they add to a mix and how much of it they keep, and the probability where a path ends."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, log_w: np.ndarray) -> None:
        """From the nodes of depth SHARED - 1 and the sums of their children's."""
        levels = [Level(key, n0, n1, log_w)]
        for depth in range(SHARED - 2, -1, -1):
            levels.append(levels[-1].above(depth))
        self.keys: list[np.ndarray] = []
        self.add, self.keep, self.end = [], [], []
        for depth, level in enumerate(reversed(levels)):
            a, b = np.zeros(len(level.key)), np.ones(len(level.key))
            if depth:
                up = np.searchsorted(self.keys[-1], level.key & np.uint64((1 << 8 * depth) - 1))
                a, b = self.add[-1][up], self.keep[-1][up]
            self.keys.append(level.key)
            self.end.append(a + b * level.p)
            self.add.append(a + b * level.share * level.p)
            self.keep.append(b * (1 - level.share))

    def log10(self, g: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out = np.zeros(len(g))
        for k in range(8):
            p = np.full(len(g), 0.5)
            for depth, (key, add, keep, end) in enumerate(zip(self.keys, self.add, self.keep, self.end, strict=True)):
                if len(key):
                    node = _nodes(g, k, depth)
                    at = np.minimum(np.searchsorted(key, node), len(key) - 1)
                    known = key[at] == node
                    p = np.where(known, end[at], p)
                    if depth == SHARED - 1:
                        deeper = known & ~np.isnan(mix[:, k])
                        p = np.where(deeper, add[at] + keep[at] * mix[:, k], p)
            one = g >> np.uint64(7 - k) & np.uint64(1)
            out += np.log10(np.where(one == 1, p, 1 - p))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of documents: their numbers, folds, the ends of their texts, and the texts, compressed."""
    rows, size = [], 0

    def row() -> pa.RecordBatch:
        doc, held, texts = zip(*rows, strict=True)
        rows.clear()
        ends = np.cumsum([len(t) for t in texts])
        text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int64())), pa.array([text], pa.binary())], ["doc", "held", "ends", "text"])

    for b in batches:
        for d, held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            rows.append((d, held, (t.as_py() or b"").lower()))
            size += len(rows[-1][2])
            if size > BLOCK_BYTES:
                yield row()
                size = 0
    if rows:
        yield row()


def _texts(ends: list[int], text: bytes) -> Iterator[bytes]:
    whole, at = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, ends[-1])) if ends[-1] else b"", 0
    for end in ends:
        yield whole[at:end]
        at = end


def _tallies(ends: list[int], held: list[bool], text: bytes) -> tuple[Tally, Tally]:
    """A block's words and grams."""
    both = (Tally(), Tally())
    for t, h in zip(_texts(ends, text), held, strict=True):
        both[WORDS].add(word_hashes(t), not h)
        for g in grams(t):
            both[GRAMS].add(g, not h)
    return both


def _ranged(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by ranges of their hashes, the ranges, and where each starts."""
    bucket = (keys * _M >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return order, bucket[first], first


def _cuts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct words and grams and their training counts, cut by ranges of hashes."""
    for b in batches:
        for r in b.to_pylist():
            for kind, tally in enumerate(_tallies(r["ends"], r["held"], r["text"])):
                keys, n = tally.result()
                order, bucket, first = _ranged(keys, bits)
                cut = lambda x: pa.array([p.tobytes() for p in np.split(x[order], first[1:])], pa.binary())  # noqa: B023, E731
                m = len(bucket)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * m), pa.array([kind] * m, pa.int32()), pa.array(bucket), cut(keys), cut(n.astype(np.uint32))], ["block", "kind", "bucket", "keys", "n"])


_SUMS = "kind int, bucket bigint, blocks array<string>, sizes array<bigint>, at binary, keys binary, n binary, tokens bigint, distinct bigint"


def _summed(t: pa.Table) -> pa.Table:
    """For one range of hashes: its distinct keys, their sums over all blocks, and each block's places among them."""
    pieces = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]
    key, at = np.unique(np.concatenate(pieces), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("n")]), len(key)).astype(np.int64)
    row = {"kind": [t.column("kind")[0].as_py()], "bucket": [t.column("bucket")[0].as_py()], "blocks": [t.column("block").to_pylist()], "sizes": [[len(p) for p in pieces]],
           "at": [at.astype(np.int32).tobytes()], "keys": [key.tobytes()], "n": [n.tobytes()], "tokens": [int(n.sum())], "distinct": [int((n > 0).sum())]}
    types = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({k: pa.array(v, ty) for (k, v), ty in zip(row.items(), types, strict=True)})


def _each_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, n in zip(b.column(0), b.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], ["g", "n"])


def _valued(batches: Iterator[pa.RecordBatch], shallow: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    """Each gram's range and log10 probability."""
    for b in batches:
        g = b.column(0).to_numpy().astype(np.uint64)
        mix = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([pa.array((g * _M >> np.uint64(64 - bits)).astype(np.int64)), b.column(0), pa.array(shallow.value.log10(g, mix))], ["bucket", "g", "v"])


_BACK = "block string, kind int, bucket bigint, data binary"


def _spread(kind: int, bucket: int, blocks: list[str], sizes: list[int], at: bytes, values: np.ndarray) -> pa.Table:
    """A range's values, for each block in the order of its keys."""
    x = np.split(values[np.frombuffer(at, np.int32)], np.cumsum(sizes)[:-1])
    m = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.string()), "kind": pa.array([kind] * m, pa.int32()), "bucket": pa.array([bucket] * m, pa.int64()), "data": pa.array([p.tobytes() for p in x], pa.binary())})


def _word_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield from _spread(WORDS, r["bucket"], r["blocks"], r["sizes"], r["at"], np.frombuffer(r["n"], np.int64)).to_batches()


def _gram_back(sums: pa.Table, values: pa.Table) -> pa.Table:
    (r,) = sums.to_pylist()
    g = values.column("g").to_numpy().astype(np.uint64)
    v = values.column("v").to_numpy()[np.argsort(g)].astype(np.float32)  # as many as keys, and in their order
    return _spread(GRAMS, r["bucket"], r["blocks"], r["sizes"], r["at"], v)


class Lookup:
    """Values of sorted keys: by a table of hashed places first, then by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, min(24, int(len(keys)).bit_length() + 1)))
        self.place = np.zeros(1 << int(np.uint64(64) - self.shift), np.int32)
        self.place[(keys * _M >> self.shift).astype(np.intp)] = np.arange(len(keys))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = self.place[(x * _M >> self.shift).astype(np.intp)]
        other = np.flatnonzero(self.keys[at] != x)
        at[other] = np.searchsorted(self.keys, x[other])
        return self.values[at]


def _lookup(tally: Tally, back: list[dict], kind: int, bits: int, dtype: type) -> Lookup:
    keys, _ = tally.result()
    data = b"".join(x["data"] for x in sorted((x for x in back if x["kind"] == kind), key=lambda x: x["bucket"]))
    values = np.empty(len(keys), dtype)
    values[_ranged(keys, bits)[0]] = np.frombuffer(data, dtype)
    return Lookup(keys, values)


def _finished(batches: Iterator[pa.RecordBatch], bits: int, tokens: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the values of their words and grams, back to one row for each document."""
    for b in batches:
        for r in b.to_pylist():
            tallies = _tallies(r["ends"], r["held"], r["text"])
            count = _lookup(tallies[WORDS], r["back"], WORDS, bits, np.int64)
            value = _lookup(tallies[GRAMS], r["back"], GRAMS, bits, np.float32)
            out = []
            for t in _texts(r["ends"], r["text"]):
                c = count(word_hashes(t))
                base = np.log10((c + ALPHA) / (tokens + ALPHA * (distinct + 1))).sum()
                score = sum(float(value(g).sum(dtype=np.float64)) for g in grams(t))
                out.append((len(c), int((c > 0).sum()), float(base), score, -score * math.log2(10) / (len(t) + 1)))
            n_tokens, known, base, score, per_byte = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(out), pa.int64()), *[pa.array(x, pa.float64()) for x in (base, score, per_byte)]],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )


def tree(counts: DataFrame, groups: int) -> tuple[DataFrame, Shallow]:
    """Of grams and training counts (g, n): each gram's mix of DEPTH to SHARED (g, mix), and the depths below."""
    ctx = F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    parts = written(counts.groupBy(F.pmod(F.xxhash64(ctx), F.lit(groups)).alias("group")).applyInPandas(lambda pdf: _parts(pdf), _PART), "ctw-parts")
    up = F.col("key").bitwiseAND(F.lit((1 << 8 * SHARED) - 1))  # a context of SHARED - 1 bytes, and the bits so far
    nodes = parts.filter("key is not null").groupBy(up.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("log_w"))
    found = nodes.toArrow().sort_by("key")  # at most 255 nodes for each of 65,536 contexts
    return parts.filter("key is null").select("g", "mix"), Shallow(found["key"].to_numpy().astype(np.uint64), *(found[c].to_numpy() for c in ("n0", "n1", "log_w")))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, one row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held"), F.col("text").cast("binary").alias("text"))
    blocks = rows.mapInArrow(_blocks, "doc array<bigint>, held array<boolean>, ends array<bigint>, text binary")
    blocks = written(blocks.select(F.expr("uuid()").alias("block"), "*"), "ctw-blocks")
    bits = max(5, math.ceil(math.log2(max(1, blocks.count()) / 2)))  # two blocks' grams for each range
    cuts = blocks.mapInArrow(partial(_cuts, bits=bits), "block string, kind int, bucket bigint, keys binary, n binary")
    sums = written(cuts.groupBy("kind", "bucket").applyInArrow(_summed, _SUMS), "ctw-sums")
    size = {r["kind"]: r for r in sums.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.sum(F.octet_length("keys") / 8).alias("keys")).collect()}  # two rows
    of = lambda kind: sums.filter(F.col("kind") == kind)
    groups = 1 if not size else max(8, math.ceil(size[GRAMS]["keys"] / GROUP))
    mixes, shallow = tree(of(GRAMS).select("keys", "n").mapInArrow(_each_gram, "g bigint, n bigint"), groups)
    values = mixes.mapInArrow(partial(_valued, shallow=spark.sparkContext.broadcast(shallow), bits=bits), "bucket bigint, g bigint, v double")
    back = of(GRAMS).select("bucket", "blocks", "sizes", "at").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_gram_back, _BACK)
    back = back.union(of(WORDS).select("bucket", "blocks", "sizes", "at", "n").mapInArrow(_word_back, _BACK))
    back = back.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("back"))  # as many as there are ranges
    met = blocks.join(back, "block").select("doc", "held", "ends", "text", "back")
    tokens, distinct = (size[WORDS]["tokens"], size[WORDS]["distinct"]) if size else (0, 0)
    return met.mapInArrow(partial(_finished, bits=bits, tokens=tokens, distinct=distinct), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
