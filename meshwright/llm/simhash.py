"""SimHash near-duplicates, found by the general pigeonhole principle.

Two fingerprints within ``bits`` differing bits agree, on at least one part i of the bits, up to a threshold
t_i, wherever the t_i + 1 add up to bits + 1. Bits that go together are placed side by side, and a dynamic
program cuts that order into parts with unequal thresholds (-1: never probed) at the least estimated number
of probes and candidates. Statistics come from every fingerprint.

A bucket of up to ``BUCKET`` fingerprints is verified pair by pair. The fingerprints of larger buckets are
linked exactly and in linear size: two values differ in at most 2r bits if and only if some value differs
from each in at most r, so each meets the others at its neighbours (1 + 64 for r = 1, 2081 for r = 2).

Null and empty texts have the fingerprint zero, linked like any other. Copies collapse to one fingerprint
before anything is linked, so no group of copies is ever expanded. Where a similarity is asked for, candidates
share a bucket of least hashes of their sets of shingles (``near_copies``) instead, and links are verified by the
whole sets. Rows with a null doc_id take part and get the component's smallest doc_id. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table
from meshwright.operators.components import connected_components
from meshwright.shared import written

BITS = 64
#: Comparing a fingerprint with as many as it has neighbours costs no more than to shuffle those.
BUCKET = 64
#: Texts of a bucket of near copies that are compared pair by pair; what a larger one doesn't link at once goes by rare shingles.
CROWD = 16
#: Lowest hashes of a set of shingles, and what their estimate of a similarity may be off.
SKETCH, MARGIN = 256, 0.1
#: Counters of shingles' frequencies, which put rare ones first: what is broadcast has this many, whatever the texts.
COUNTERS = 1 << 18
#: Rows of three integers that are broadcast, at most.
BROADCAST_ROWS = 100_000
#: Texts that the buckets of a group of copies choose for their first comparison; texts of a crowd that a round compares with all others.
REPRESENTATIVES, TURN = 4, 64
_CHUNK = 1 << 16
#: Buckets of a set of shingles: a pair of similarity 0.8 misses all of them once in 16,000 times, one of 0.5 meets in one of 64.
BANDS, ROWS = 32, 6
_FACTORS, _TERMS = np.random.default_rng(7).integers(0, 2**32, (2, BANDS * ROWS), np.uint32) | np.array([[1], [0]], np.uint32)


def simhash(text: bytes | None, shingle: int | tuple[int, ...] = 3, count: int = 1) -> list[int]:
    """``count`` signed 64-bit fingerprints of a text's word shingles (of one or several lengths): of XXH64, and of mixes of it."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * count
    joined, total = b" ".join(words), 0
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], last[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((count, BITS), np.int64)
    for size in (shingle,) if isinstance(shingle, int) else shingle:
        ends = last[min(size, len(words)) - 1 :].tolist()
        total += len(ends)
        for k in range(0, len(ends), _CHUNK):
            h = np.array([digest(joined[a:b], 42) for a, b in zip(first[k : k + _CHUNK], ends[k : k + _CHUNK], strict=False)], "<u8")
            for c in range(count):
                ones[c] += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<i8").ravel().tolist()


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int | tuple[int, ...], count: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([simhash(t.as_py(), shingle, count) for t in b.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2)], ["doc_id", "fp", "content"])


def _readable(docs: DataFrame) -> DataFrame:
    """doc_id, text (UTF-8) and content (a hash of the text)."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return d.withColumn("content", F.xxhash64("text"))


def fingerprints(docs: DataFrame, shingle: int | tuple[int, ...] = 3, count: int = 1) -> DataFrame:
    """doc_id, fp (an array of ``count`` fingerprints) and content (a hash of the text), one row for each input row."""
    return _readable(docs).mapInArrow(partial(_fingerprints, shingle=shingle, count=count), "doc_id bigint, fp array<bigint>, content bigint")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many set bit i and bit j, for all i and j."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(h), _CHUNK):
                x = np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(count, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:  # 64 * 64 + 1 sums, whatever the input
        found[r["i"] * BITS + r["j"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def bit_order(n: int, both: np.ndarray) -> list[int]:
    """The bits in an order that puts correlated ones side by side: each next is the one closest to the last."""
    p = np.diag(both) / max(n, 1)
    var = p * (1 - p)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.maximum(np.outer(var, var), 1e-12))
    order = [int(np.argmax(corr.sum(0)))]
    while len(order) < len(p):
        order.append(max((i for i in range(len(p)) if i not in order), key=lambda i: (corr[order[-1], i], -i)))
    return order


def allocate(n: int, differ: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Parts (first, end, threshold) of the ordered bits at the least estimated cost.

    ``differ[k]``: the probability that two fingerprints differ in the k-th bit of the order. A part costs its
    probes and the pairs expected to meet in it; thresholds plus one add up to bits + 1 over the parts.
    """
    width = len(differ)
    cost = np.full((width, width + 1, bits + 2), np.inf)  # of a part (first, end) by its threshold + 1
    for first in range(width):
        near = np.zeros(bits + 1)  # the probability of 0, 1, ... differing bits in the part
        near[0] = 1.0
        for end in range(first + 1, width + 1):
            q = differ[end - 1]
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
            probes = np.cumsum([math.comb(end - first, t) for t in range(bits + 1)])
            cost[first, end] = np.concatenate(([0.0], n * probes + n * n / 2 * np.cumsum(near)))
    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for end in range(1, width + 1):
        for first in range(end):
            for used in range(bits + 2):
                if (first, used) not in best:
                    continue
                before, parts = best[first, used]
                for t in range(-1, bits - used + 1):
                    new = before + cost[first, end, t + 1]
                    if (end, used + t + 1) not in best or new < best[end, used + t + 1][0]:
                        best[end, used + t + 1] = (new, [*parts, (first, end, t)])
    return [p for p in best[width, bits + 1][1] if p[2] >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(places: list[int], threshold: int) -> Column:
    """The masks of up to ``threshold`` of these bits, as one constant array."""
    masks = [sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(places, t)]
    return F.transform(F.split(F.lit(" ".join(str(_signed(m)) for m in masks)), " "), lambda x: x.cast("bigint"))


def _prober(part: int, key: Column) -> Callable[[Column], Column]:
    return lambda flipped: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(flipped).alias("key"))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs a < b that connect all fingerprints of one set s within ``bits`` differing bits (2 or 4).

    ``fps``: distinct (s, fp). Pairs that share a bucket of more than ``BUCKET`` are given through the smallest
    fingerprint that is as near to a common neighbour as they are. Joins are merged: an exploded side is far
    larger than Spark's estimate of it, and must not be broadcast.
    """
    if bits not in (2, 4):
        raise ValueError("bits must be 2 or 4")
    n, both = bit_counts(fps)
    order = bit_order(n, both)
    p = np.diag(both)[order] / max(n, 1)
    parts = allocate(n, 2 * p * (1 - p), bits)
    exact, probes = [], []
    for k, (first, end, t) in enumerate(parts):
        mask = F.lit(_signed(sum(1 << b for b in order[first:end]))).cast("bigint")
        key = F.col("fp").bitwiseAND(mask)
        exact.append(_prober(k, key)(F.lit(0).cast("bigint")))
        probes.append(F.transform(_flips(order[first:end], t), _prober(k, key)))
    bucket = ["s", "part", "key"]
    at = fps.select("s", "fp", F.explode(F.array(*exact)).alias("x")).select("s", "x.*", "fp")
    probe = fps.select("s", "fp", F.explode(F.concat(*probes)).alias("x")).select("s", "x.*", "fp")
    sizes = at.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    # a fingerprint that meets nothing but itself needs no more work
    met = written(probe.hint("merge").join(sizes, bucket).filter("n > 1 or one <> fp").drop("one"), "simhash-probes")
    few = at.hint("merge").join(sizes.filter((F.col("n") <= BUCKET) & (F.col("n") > (0 if any(t for _, _, t in parts) else 1))).select(*bucket), bucket)
    few = few.groupBy(*bucket).agg(F.collect_list("fp").alias("members"))
    pairs = met.filter(F.col("n") <= BUCKET).hint("merge").join(few, bucket)
    pairs = pairs.select("s", F.col("fp").alias("a"), F.explode(F.filter("members", lambda m: F.bit_count(m.bitwiseXOR(F.col("fp"))) <= bits)).alias("b"))
    pairs = pairs.filter("a <> b").select("s", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # what probes a crowded bucket, and what it holds
    crowded = met.filter(F.col("n") > BUCKET).select(*bucket).distinct()
    many = met.filter(F.col("n") > BUCKET).select("s", "fp").union(at.hint("merge").join(crowded, bucket, "left_semi").select("s", "fp")).distinct()
    flips = _flips(list(range(BITS)), bits // 2)
    near = many.select("s", "fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    meet = near.groupBy("s", "v").agg(F.collect_list("fp").alias("m")).filter("size(m) > 1")  # a value has as many neighbours as there are flips
    pair = meet.select("s", F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")
    return pairs.union(pair).distinct()


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted 32-bit hashes of a text's different word shingles; of a shorter text, of all its words."""
    words = (text or b"").lower().split()
    size = min(shingle, len(words))
    grams = {xxhash.xxh32_intdigest(b" ".join(words[k : k + size])) for k in range(len(words) - size + 1)} if words else set()
    return np.sort(np.fromiter(grams, np.uint32, len(grams)))


def bands(grams: np.ndarray) -> np.ndarray:
    """A set's ``BANDS`` bucket numbers, each of the least values of ``ROWS`` permutations of its hashes."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[k : k + 1024, None] * _FACTORS + _TERMS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([bands(shingle_set(t.as_py(), shingle)) for t in b.column(1)], pa.list_(pa.int64()))
        fp = pa.array([simhash(t.as_py())[0] for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp, found], ["doc_id", "content", "fp", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py(), shingle).view(np.int32) for t in b.column(1)]
        low = pa.array([x[:SKETCH] for x in sets], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), low, pa.array(sets, pa.list_(pa.int32()))], ["node", "size", "low", "shingles"])


def _estimated(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges that may be similar; ``sure`` where the lowest hashes of both sets settle it. One sure edge of two roots in a batch is enough."""
    for b in batches:
        sure, linked = [], set()
        for roots, m, n, p, q in zip(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6), b.column(7), strict=True):
            if roots in linked:
                sure.append(None)
                continue
            _, times = np.unique(np.concatenate((p.values.to_numpy().view(np.uint32), q.values.to_numpy().view(np.uint32))), return_counts=True)
            whole = max(m, n) <= SKETCH
            times = times if whole else times[:SKETCH]
            found = (times == 2).mean() if len(times) else 1.0
            sure.append(bool(found >= similarity + (0 if whole else MARGIN)) or (None if whole or found < similarity - MARGIN else False))
            if sure[-1]:
                linked.add(roots)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sure, pa.bool_())], ["x", "y", "root_x", "root_y", "sure"])


def shingle_sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node, size, low (the ``SKETCH`` lowest hashes) and shingles of the texts of ``nodes`` (node, first: a doc_id, content)."""
    needed = written(nodes.select("node", F.col("first").alias("doc_id"), "content"), "simhash-needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed  # else every text is shuffled
    rows = _readable(docs).withColumnsRenamed({"doc_id": "d", "content": "c"})
    rows = rows.join(needed, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("content"))).select("node", "text")
    sets = rows.mapInArrow(partial(_shingle_sets, shingle=shingle), "node bigint, size int, low array<int>, shingles array<int>")
    return written(sets.dropDuplicates(["node"]), "simhash-shingles")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(root_x, root_y): roots that edges (x, y, root_x, root_y) link whose texts' ``shingle_sets`` have a Jaccard similarity of ``similarity`` or more.

    Two texts without a word are alike. The sizes and the ``SKETCH`` lowest hashes decide what is further than ``MARGIN``
    (four standard errors) from the similarity; whole sets decide the rest, so long sets seldom travel.
    """
    ends = ["x", "y", "root_x", "root_y"]
    of = lambda end, c: sets.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col(c).alias(f"of_{end}"))
    low = edges.hint("merge").join(of("x", "low"), "x").hint("merge").join(of("y", "low"), "y")
    low = low.filter(F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y"))
    judged = low.select(*ends, "size_x", "size_y", "of_x", "of_y").mapInArrow(partial(_estimated, similarity=similarity), "x bigint, y bigint, root_x bigint, root_y bigint, sure boolean")
    judged = written(judged.filter("sure is not null"), "simhash-judged")
    both = judged.filter("not sure").select(*ends).hint("merge").join(of("x", "shingles"), "x").hint("merge").join(of("y", "shingles"), "y")
    shared = F.size(F.array_intersect("of_x", "of_y"))
    exact = both.filter(shared >= similarity * (F.size("of_x") + F.size("of_y") - shared))
    return judged.filter("sure").select("root_x", "root_y").union(exact.select("root_x", "root_y"))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of all sets fall to each of ``COUNTERS`` counters: an order of rarity that needs no table of shingles."""
    slot = F.explode(F.transform("shingles", lambda x: x.bitwiseAND(F.lit(COUNTERS - 1))))
    rows = sets.select(slot.alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _prefixes(batches: Iterator[pa.RecordBatch], counts, similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, node, pos, size) of the rarest shingles of sets (node, size, shingles): those that a set similar to it must share one of."""
    for b in batches:
        nodes, at = b.column(0).to_numpy(), [np.empty((0, 3), np.int64)]
        for node, x in enumerate(b.column(2)):
            tokens = x.values.to_numpy().view(np.uint32)
            times = counts.value[tokens & np.uint32(COUNTERS - 1)]
            order = np.lexsort((tokens, times))[: len(tokens) - math.ceil(similarity * len(tokens) - 1e-9) + 1]
            pos = np.flatnonzero(times[order] > 1)  # a shingle that no other set has leads nowhere
            at.append(np.stack([tokens[order][pos].astype(np.int64), np.full(len(pos), node), pos], axis=1))
        key, row, pos = np.concatenate(at).T
        sizes = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[row]), pa.array(pos.astype(np.int32)), pa.array(sizes[row])], ["key", "node", "pos", "size"])


def postings(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, pos, size): sets by their rarest shingles, enough of them for any two similar sets to share one."""
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))
    return sets.select("node", "size", "shingles").mapInArrow(partial(_prefixes, counts=counts, similarity=similarity), "key bigint, node bigint, pos int, size int")


def plausible(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets that share a shingle at these places (node, pos, size) can be similar, if it is the rarest that they share.

    Sets of m and n shingles must share s / (1 + s) (m + n). That many must be left from either place on, and the smaller
    set has a shingle among its first m - 2 s / (1 + s) m + 1.
    """
    part = similarity / (1 + similarity)
    needed = part * (x["size"] + y["size"]) - 1e-9
    small = F.when((x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["node"] < y["node"])), x).otherwise(y)
    first = small["pos"] <= small["size"] - 2 * part * small["size"] + 1e-9
    return first & (F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= needed) & (F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"]) - 1e-9)


def _settled(nodes: DataFrame, found: DataFrame, crowds: DataFrame, alike: Callable[[DataFrame], DataFrame], plausible: Callable[[Column, Column], Column]) -> DataFrame:
    """The components (node, root) of ``nodes`` under the edges ``found`` (root_x, root_y) and all plausible pairs of a crowd that ``alike`` keeps.

    ``crowds``: (key, node, pos, size). In each crowd that isn't one component yet, nodes of different components are compared: all of
    them in a crowd of up to ``BUCKET``; in a larger one, round by round, some outside its largest component with all
    others, which takes them out. Four times as many nodes a round keep the rounds logarithmic. A pair is compared once. What a round
    links are components, so later rounds work on their roots alone.
    """
    root = connected_components(found, "root_x", "root_y")
    root = written(nodes.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "simhash-roots")
    several, before = TURN, None
    ordered = lambda x, y: F.when(x["node"] < y["node"], F.struct(x["node"].alias("x"), y["node"].alias("y"), x["root"].alias("root_x"), y["root"].alias("root_y"))).otherwise(F.struct(y["node"].alias("x"), x["node"].alias("y"), y["root"].alias("root_x"), x["root"].alias("root_y")))
    apart = lambda x, y: (x["root"] != y["root"]) & plausible(x, y)
    while True:
        named = crowds.join(root, "node").select("key", F.struct("node", "root", "pos", "size").alias("at"))
        main = named.groupBy("key", "at.root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).filter("parts > 1")
        named = written(named.join(main.select("key", "n", F.col("main.root").alias("main")), "key"), "simhash-crowds")
        if named.isEmpty():
            return root
        few = named.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("at").alias("m")).select(F.explode("m").alias("x"), "m")
        few = few.select("x", F.explode(F.filter("m", lambda y: (y["node"] > F.col("x.node")) & apart(F.col("x"), y))).alias("y"))
        many = named.filter(F.col("n") > BUCKET)
        turn = many.filter("at.root <> main").groupBy("key", F.pmod(F.xxhash64("at.node"), F.lit(several)).alias("k")).agg(F.min("at").alias("x")).drop("k")
        turn = written(turn, "simhash-turn")
        crowd = many.select("key", F.col("at").alias("y")).join(turn, "key").filter(apart(F.col("x"), F.col("y"))).select("x", "y")
        pairs = few.union(crowd).select(ordered(F.col("x"), F.col("y")).alias("p")).select("p.*").distinct()
        if before is not None:
            pairs = pairs.join(before, ["x", "y"], "left_anti")
        pairs = written(pairs, "simhash-pairs")
        more = written(alike(pairs).distinct(), "simhash-found")
        before = pairs.select("x", "y") if before is None else before.union(pairs.select("x", "y"))
        if not more.isEmpty():
            up = connected_components(more, "root_x", "root_y").select(F.col("node").alias("root"), F.col("root").alias("up"))
            root = written(root.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "simhash-roots")
        left = many.select("key", F.col("at.node").alias("node"), F.col("at.pos").alias("pos"), F.col("at.size").alias("size"))
        crowds = left.join(turn.select("key", F.col("x.node").alias("node")), ["key", "node"], "left_anti")
        several *= 4


def near_copies(docs: DataFrame, similarity: float, shingle: int = 5) -> DataFrame:
    """doc_id, content (a hash of the text) and root (the component's smallest content), one row for each input row.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is ``similarity`` or more. Compared are
    texts whose SimHash fingerprints ``links`` finds within 2 bits. What is further apart than that at this similarity follows: pairs
    that share one of ``BANDS`` buckets are compared, wherever in the text an edit lies. Buckets of more than ``CROWD`` texts
    are compared with one text of theirs (of ``REPRESENTATIVES`` that a group's buckets choose). What isn't linked then
    meets by its rarest shingles (``postings``), enough of them that no similar pair of these texts is lost, until none is
    left that isn't linked through others (``_settled``). So a crowd that shares much, but less than the similarity, makes no pairs.
    """
    prints = written(_readable(docs).mapInArrow(partial(_banded, shingle=shingle), "doc_id bigint, content bigint, fp bigint, bands array<bigint>"), "simhash-bands")
    distinct = written(prints.groupBy(F.col("content").alias("node")).agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "simhash-distinct")
    # texts of one fingerprint meet the first of them, and the first ones of near fingerprints meet
    own = written(distinct.groupBy("fp").agg(F.min("node").alias("own")), "simhash-own")
    end = lambda fp, x: own.select(F.col("fp").alias(fp), F.col("own").alias(x))
    linked = links(own.select(F.lit(0).alias("s"), "fp")).hint("merge").join(end("a", "x"), "a").hint("merge").join(end("b", "y"), "b").select("x", "y")
    linked = linked.union(distinct.select("node", "fp").hint("merge").join(own, "fp").filter("node <> own").select(F.col("own").alias("x"), F.col("node").alias("y")))
    linked = written(linked.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "simhash-links")
    at = distinct.select("node", F.posexplode("bands").alias("band", "key"))
    pick = F.struct(F.xxhash64("node", F.col("band") % REPRESENTATIVES), "node")
    sizes = at.groupBy("key").agg(F.count("*").alias("n"), F.min(pick).alias("one")).filter("n > 1").select("key", "n", F.col("one.node").alias("one"))
    met = written(at.drop("band").hint("merge").join(sizes, "key"), "simhash-met")
    # most buckets of a group hold the same texts
    few = met.filter(F.col("n") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m")).select("m").distinct()
    pairs = few.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y > F.col("x"))).alias("y"))
    star = met.filter((F.col("n") > CROWD) & (F.col("node") != F.col("one"))).select(F.least("one", "node").alias("x"), F.greatest("one", "node").alias("y"))
    edges = linked.union(pairs).union(star).distinct().select("x", "y", F.col("x").alias("root_x"), F.col("y").alias("root_y"))
    nodes = met.select("node").union(linked.select(F.explode(F.array("x", "y")).alias("node")))
    nodes = written(nodes.distinct(), "simhash-nodes")
    sets = shingle_sets(distinct.join(nodes, "node", "left_semi").select("node", "first", F.col("node").alias("content")), docs, shingle)
    found = written(similar(edges, sets, similarity), "simhash-found")
    crowd = sets.join(met.filter(F.col("n") > CROWD).select("node").distinct(), "node", "left_semi")
    crowds = written(postings(crowd, similarity), "simhash-postings")
    root = _settled(nodes, found, crowds, partial(similar, sets=sets, similarity=similarity), partial(plausible, similarity=similarity))
    return prints.select("doc_id", "content").join(root.withColumnRenamed("node", "content"), "content", "left").select("doc_id", "content", F.coalesce("root", "content").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int | tuple[int, ...] = 3, bits: int = 2, count: int = 1, similarity: float | None = None) -> DataFrame:
    """doc_id, fp (the first fingerprint) and component_id, one row for each input row.

    Documents link if any of their ``count`` fingerprints are within ``bits`` bits or, where a ``similarity`` is
    given, if the Jaccard similarity of their texts' sets of 5-word shingles is at least that, whatever their
    fingerprints. component_id is the smallest doc_id reachable over links.
    """
    prints = written(fingerprints(docs, shingle, count), "simhash")
    if similarity is not None:
        copies = written(near_copies(docs, similarity), "simhash-copies")
        lowest = copies.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of = copies.select("content", "root").distinct().join(lowest, "root").select("content", "component_id")
        return prints.join(of, "content").select("doc_id", F.col("fp")[0].alias("fp"), "component_id")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("fp") if count > 1 else F.col("fp")[0])
    distinct = written(distinct, "simhash-distinct")
    each = distinct.select("node", F.posexplode("fp").alias("s", "fp"))
    own = written(each.groupBy("s", "fp").agg(F.min("node").alias("node")), "simhash-own")
    ends = links(own.select("s", "fp"), bits)
    if count > 1:  # from fingerprints to the nodes' numbers, and between nodes that share a fingerprint
        of = lambda end, x: own.select("s", F.col("fp").alias(end), F.col("node").alias(x))
        edges = ends.hint("merge").join(of("a", "x"), ["s", "a"]).hint("merge").join(of("b", "y"), ["s", "b"]).select("x", "y")
        shared = each.hint("merge").join(own.withColumnRenamed("node", "y"), ["s", "fp"]).filter("node <> y")
        edges = edges.union(shared.select(F.col("node").alias("x"), "y"))
    else:
        edges = ends.select(F.col("a").alias("x"), F.col("b").alias("y"))
    root = connected_components(edges, "x", "y")
    named = distinct.join(root, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(named.join(lowest, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp").select("doc_id", F.col("fp")[0].alias("fp"), "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
