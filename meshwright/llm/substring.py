"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint is the smallest hash of the ``GRAM``-word sequences
in it, so equal windows have equal fingerprints and neighbouring windows mostly share one: about an eighth as
many rows as windows, and none lost. Each batch of documents becomes one immutable run: its fingerprints, sorted, in
buckets of their hash, so that it is merge-joined with the historical runs where they lie. A window whose fingerprint
occurs once in the batch and not in history is unique and needs nothing more. The others are verified: the two
64-bit digests of all their words are compared with those of the batch and of history, and only the first start
of each word sequence stays. History keeps the digests of all windows that were verified; a historical fingerprint that was
unique until now gives its windows' digests from the index's own copy of that document, once. Runs are compacted into one
when there are ``RUNS``.

Unique fingerprints and first starts travel back to their documents, never the copies, and each task sends a
digest once for each million of its windows, so a passage in a third of all documents costs little more than one that is
nowhere else.

Null and empty texts and texts of fewer than ``WINDOW`` words lose nothing. Documents of a batch are ordered by doc_id, and
history comes before them; rows without a doc_id are documents of their own and come last, as do further texts of a
doc_id that has several. Rows that repeat a doc_id and its text in a batch are one document, each of them judged alike. Only
doc_id and text are read. A very long text is held by one task at a time, as Spark holds the row.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm.common import table
from meshwright.shared import new_path, remove, written

WINDOW, GRAM = 20, 5
#: Runs of an index that are compacted; windows of a range of digests, about, were all of them verified.
RUNS, RANGE = 4, 1 << 21
#: Places of two integers that are broadcast, at most.
BROADCAST_ROWS = 1_000_000
_PIECE = 1 << 20
_SPAN = WINDOW - GRAM + 1
#: Odd multipliers of the two rolling digests.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Numbers from here on are of documents that have no doc_id of their own.
_LATE = 1 << 62


def _rolled(h: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """The polynomial digest of every n consecutive hashes, put together from powers of two."""
    out, size, power, done = None, 1, m, h
    offset = 0
    while True:
        if n & size:
            if out is None:
                out, offset = done, size
            else:
                k = len(h) - offset - size + 1
                out, offset = out[:k] * power + done[offset : offset + k], offset + size
        if size * 2 > n:
            return out
        done = done[:-size] * power + done[size:]
        power, size = np.uint64(int(power) ** 2 % 2**64), size * 2


def _over(op: Callable, x: np.ndarray, n: int) -> np.ndarray:
    """``op`` over every n consecutive values; n is a power of two."""
    k = 1
    while k < n:
        x, k = op(x[:-k], x[k:]), k * 2
    return x


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a document's word hashes: where fingerprints lie, their values, and each window's fingerprint."""
    if len(h) < WINDOW:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    g = _rolled(h, GRAM, _M1)
    g = (g ^ (g >> np.uint64(29))) * _M2
    g ^= g >> np.uint64(32)
    low = _over(np.minimum, g, _SPAN)
    pad = np.zeros(_SPAN - 1, np.uint64)
    at = np.flatnonzero(_over(np.maximum, np.concatenate((pad, low, pad)), _SPAN) == g)
    return at, g[at], low


def _suspects(h: np.ndarray, unique: np.ndarray | None) -> np.ndarray:
    """Starts of the windows whose fingerprint isn't unique; ``unique``: places of unique fingerprints."""
    at, fp, low = anchors(h)
    if not len(low):
        return np.zeros(0, np.int64)
    if unique is None or not len(unique):
        return np.arange(len(low))
    keep = np.ones(len(h), bool)
    keep[unique[unique < len(h)]] = False
    keep = keep[at]
    if not keep.any():
        return np.zeros(0, np.int64)
    repeated = np.full(len(low) + _SPAN - 1, 2**64 - 1, np.uint64)
    repeated[at[keep]] = fp[keep]
    return np.flatnonzero(_over(np.minimum, repeated, _SPAN) == low)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, fps, places = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            at, fp, _ = anchors(hashed((t.as_py() or b"").split()))
            docs.append(np.full(len(at), d, np.int64))
            fps.append(fp.view(np.int64))
            places.append(at.astype(np.int32))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (fps, docs, places)], ["fp", "doc", "pos"])


def _of_places(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Starts of the windows whose fingerprint lies at one of these places."""
    at, fp, low = anchors(h)
    keep = np.isin(at, places)
    if not keep.any():
        return np.zeros(0, np.int64)
    listed = np.full(len(low) + _SPAN - 1, 2**64 - 1, np.uint64)
    listed[at[keep]] = fp[keep]
    return np.flatnonzero(_over(np.minimum, listed, _SPAN) == low)


#: Digests come from those that history verified, from historical texts, or from the batch.
VERIFIED, HISTORY, BATCH = 0, 1, 2
_RANGES = "bucket bigint, origin int, d1 binary, d2 binary, doc binary, pos binary"


def _first_of(d1: np.ndarray, d2: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first of each digest, by the further columns."""
    at = np.lexsort((*reversed(order), d2, d1))
    a, b = d1[at], d2[at]
    return at[np.concatenate((np.ones(min(1, len(at)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]


def _ranged(parts: list[list[np.ndarray]], origin: int, bits: int) -> pa.RecordBatch:
    """Digests and starts, each digest once, as a row for each range of digests."""
    d1, d2, doc, pos = (np.concatenate([p[k] for p in parts]) for k in range(4))
    at = _first_of(d1, d2, doc, pos)
    bucket = (d1[at] >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), bucket[1:] != bucket[:-1])))
    cut = lambda x: pa.array([p.tobytes() for p in np.split(x[at], first[1:])] if len(at) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([origin] * len(first), pa.int32()), cut(d1), cut(d2), cut(doc), cut(pos)], ["bucket", "origin", "d1", "d2", "doc", "pos"])


def _window_rows(batches: Iterator[pa.RecordBatch], origin: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The digests of a batch's windows whose fingerprint isn't unique, or of a historical text's at the given places."""
    parts, size = [], 0
    for b in batches:
        for d, t, u in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            h = hashed((t.as_py() or b"").split())
            places = u.values.to_numpy() if u.is_valid else None
            at = _suspects(h, places) if origin == BATCH else _of_places(h, places)
            if len(at):
                parts.append([_rolled(h, WINDOW, _M1)[at], _rolled(h, WINDOW, _M2)[at], np.full(len(at), d, np.int64), at.astype(np.int32)])
                size += len(at)
                if size >= _PIECE:
                    yield _ranged(parts, origin, bits)
                    parts, size = [], 0
    if parts:
        yield _ranged(parts, origin, bits)


def _verified_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d1, d2 = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        if len(d1):
            yield _ranged([[d1, d2, np.zeros(len(d1), np.int64), np.zeros(len(d1), np.int32)]], VERIFIED, bits)


_FIRST = "d1 bigint, d2 bigint, doc bigint, pos int, origin int"


def _firsts(t: pa.Table) -> pa.Table:
    """For one range of digests: the first of each, unless history has verified it."""
    d1, d2, doc, pos = (np.concatenate([np.frombuffer(x.as_py(), ty) for x in t.column(c)]) for c, ty in (("d1", np.uint64), ("d2", np.uint64), ("doc", np.int64), ("pos", np.int32)))
    origin = np.repeat(np.array(t.column("origin").to_pylist(), np.int32), [len(x.as_py()) // 8 for x in t.column("d1")])
    at = _first_of(d1, d2, origin, doc, pos)
    at = at[origin[at] != VERIFIED]
    return pa.table({"d1": d1[at].view(np.int64), "d2": d2[at].view(np.int64), "doc": doc[at], "pos": pos[at], "origin": origin[at]})


def kept_words(words: list[bytes], removed: np.ndarray) -> tuple[int, list[bytes]]:
    """How many words windows at these starts cover, and the others."""
    if not len(removed):
        return 0, words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, removed, 1)
    np.add.at(cover, removed + WINDOW, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, text, unique, first, doc_id = b.columns
        n_words, n_removed, kept = [], [], []
        for t, u, f in zip(text, unique, first, strict=True):
            words = (t.as_py() or b"").split()
            at = _suspects(hashed(words), u.values.to_numpy() if u.is_valid else None)
            if f.is_valid:
                at = np.setdiff1d(at, f.values.to_numpy(), assume_unique=True)
            gone, left = kept_words(words, at)
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(left))
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
        yield pa.RecordBatch.from_arrays([doc, doc_id, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), sha, pa.array(kept, pa.binary())], ["doc", "doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


_MANIFEST = "kind string, k int, name string, path string, batches int, buckets int"


class FingerprintIndex:
    """What batches leave for those to come, in tables of the shared folder that never change.

    ``runs``: tables (fp, n, batch, doc, pos), sorted and bucketed by fp: how often a fingerprint occurs; where, if it does once.
    ``digests``: (d1, d2) of the windows that were verified, sorted. ``texts``: a table of each batch, bucketed by doc.
    ``spent`` names what compaction has replaced; results that aren't read yet may need it, so ``clean`` removes it when told to.
    ``store`` writes a manifest, and ``open`` goes on from it in another session.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches = 0
        self.runs: list[str] = []
        self.digests: list[str] = []
        self.texts: list[str] = []
        self.spent: list[str] = []
        self.paths: dict[str, str] = {}

    def write_run(self, rows: DataFrame) -> str:
        """A run of rows (fp, n, batch, doc, pos) with one row for each fingerprint; returns its table's name."""
        return self._save(rows.repartition(self.buckets, "fp"), "fp", True)

    def write_texts(self, rows: DataFrame) -> DataFrame:
        """A batch's rows (doc, text and others), kept for batches to come, where those of a document lie together."""
        self.texts.append(self._save(rows.withColumn("batch", F.lit(self.batches)), "doc"))
        return self.spark.table(self.texts[-1]).select(*rows.columns)

    def _save(self, rows: DataFrame, key: str, order: bool = False) -> str:
        name = f"substring_{key}_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "index")
        w = rows.write.format("parquet").bucketBy(self.buckets, key)
        (w.sortBy(key) if order else w).option("path", self.paths[name]).saveAsTable(name)
        return name

    def run_of(self, docs: DataFrame) -> str:
        """The run of a batch (columns doc, text)."""
        rows = docs.select("doc", "text").mapInArrow(_anchor_rows, "fp bigint, doc bigint, pos int")
        return self.write_run(rows.groupBy("fp").agg(F.count("*").alias("n"), F.lit(self.batches).alias("batch"), F.min("doc").alias("doc"), F.min("pos").alias("pos")))

    def seen(self, run: str) -> DataFrame:
        """fp, n, doc and pos of a batch's run, merge-joined with every historical run: ``before``, how often history has it, and ``at``, a place there."""
        rows = self.spark.table(run).select("fp", "n", "doc", "pos")
        before, at = F.lit(0).cast("bigint"), F.lit(None).cast("struct<batch: int, doc: bigint, pos: int>")
        for k, old in enumerate(self.runs):
            h = self.spark.table(old).select("fp", F.col("n").alias(f"n{k}"), F.struct("batch", "doc", "pos").alias(f"at{k}"))
            rows = rows.join(h.hint("merge"), "fp", "left")
            before, at = before + F.coalesce(f"n{k}", F.lit(0).cast("bigint")), F.coalesce(at, f"at{k}")
        return rows.select("fp", "n", "doc", "pos", before.alias("before"), at.alias("at"))

    def historical(self, seen: DataFrame, bits: int) -> DataFrame | None:
        """Digests by range: those that history verified, and those of the fingerprints that it had once and this batch has too."""
        if not self.runs:
            return None
        places = written(seen.filter("before = 1").select("at.batch", "at.doc", "at.pos"), "substring-places")
        few = places.count() <= BROADCAST_ROWS
        places = places.groupBy("batch", "doc").agg(F.collect_list("pos").alias("places"))  # a document's fingerprints at most
        texts = reduce(DataFrame.union, [self.spark.table(x).select("batch", "doc", "text") for x in self.texts]).join(F.broadcast(places) if few else places, ["batch", "doc"])
        out = texts.select("doc", "text", "places").mapInArrow(partial(_window_rows, origin=HISTORY, bits=bits), _RANGES)
        verified = self.spark.read.schema("d1 bigint, d2 bigint").parquet(*self.digests)
        return out.union(verified.mapInArrow(partial(_verified_rows, bits=bits), _RANGES))

    def append(self, run: str, firsts: DataFrame) -> None:
        """Make a judged batch history: its run and the digests that came new; then compact."""
        self.digests.append(new_path(self.spark, "index-digests"))
        firsts.select("d1", "d2").sortWithinPartitions("d1", "d2").write.parquet(self.digests[-1])
        self.runs.append(run)
        self.batches += 1
        if len(self.runs) >= RUNS:
            self.compact()

    def merged(self) -> DataFrame:
        """One row for each fingerprint of all runs."""
        rows = None
        for run in self.runs:
            rows = self.spark.table(run) if rows is None else rows.unionByName(self.spark.table(run))
        return rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("batch").alias("batch"), F.min("doc").alias("doc"), F.min("pos").alias("pos"))

    def compact(self) -> None:
        """Replace all runs by one."""
        if len(self.runs) > 1:
            run = self.write_run(self.merged())
            self.spent += self.runs
            self.runs = [run]

    def compact_all(self) -> None:
        """Replace runs, digests and texts by one table of each kind, so that a long history isn't one of many small tables."""
        self.compact()
        if len(self.digests) > 1:
            path = new_path(self.spark, "index-digests")
            every = self.spark.read.schema("d1 bigint, d2 bigint").parquet(*self.digests)
            every.repartitionByRange(self.buckets, "d1", "d2").sortWithinPartitions("d1", "d2").write.parquet(path)
            self.spent += self.digests
            self.digests = [path]
        if len(self.texts) > 1:
            columns = ["batch", "doc", "text"]
            rows = reduce(DataFrame.union, [self.spark.table(x).select(*columns) for x in self.texts])
            name = self._save(rows.repartition(self.buckets, "doc"), "doc")
            self.spent += self.texts
            self.texts = [name]

    def clean(self) -> None:
        """Remove what compaction has replaced."""
        for old in self.spent:
            self._remove(old)
        self.spent = []

    def _remove(self, name: str) -> None:
        if name in self.paths:
            self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, self.paths.pop(name, name))

    def drop(self) -> None:
        """Remove the whole index."""
        self.clean()
        for name in (*self.runs, *self.digests, *self.texts):
            self._remove(name)
        self.runs, self.digests, self.texts, self.batches = [], [], [], 0

    def store(self, path: str) -> None:
        """Write a manifest: a row for each table, from which another session opens the index. Earlier manifests there are passed over."""
        rows = [(kind, k, name, self.paths.get(name, name), self.batches, self.buckets) for kind in ("runs", "digests", "texts") for k, name in enumerate(getattr(self, kind))]
        rows = rows or [("none", 0, "", "", self.batches, self.buckets)]
        self.spark.createDataFrame(rows, _MANIFEST).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index of the latest manifest at ``path``, its tables registered in this session where they aren't."""
        rows = spark.read.schema(f"{_MANIFEST}, at timestamp").parquet(path)
        rows = rows.join(rows.agg(F.max("at").alias("at")), "at", "left_semi").orderBy("kind", "k").collect()  # a row for each table
        index = cls(spark, rows[0]["buckets"])
        index.batches = rows[0]["batches"]
        for r in rows:
            if r["kind"] != "none":
                getattr(index, r["kind"]).append(r["name"])
            if r["kind"] in ("runs", "texts"):
                index.paths[r["name"]] = r["path"]
                if not spark.catalog.tableExists(r["name"]):
                    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(r["path"]).schema)
                    by = "clustered by (fp) sorted by (fp)" if r["kind"] == "runs" else "clustered by (doc)"
                    spark.sql(f"create table {r['name']} ({columns}) using parquet {by} into {r['buckets']} buckets location '{r['path']}'")
        return index


def numbered(docs: DataFrame, name: str = "doc") -> DataFrame:
    """``docs`` and a number for each document: its doc_id, if it is the only or the first text of it."""
    own, content = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    odd = docs.select(own.alias("_own"), content.alias("_text")).groupBy("_own").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
    odd = written(odd.filter("_own is null or _least <> _most"), "substring-odd")
    late = lambda *x: F.lit(_LATE) + F.xxhash64(*x).bitwiseAND(F.lit(_LATE - 1))
    out = docs.withColumn(name, own)
    if odd.isEmpty():
        return out
    several = odd.filter("_own is not null").select(F.col("_own").alias(name), "_least")
    some = out.filter(F.col(name).isNotNull()).join(several, name, "left")
    some = some.withColumn(name, F.when(content != F.col("_least"), late(name, content)).otherwise(F.col(name)))
    none = out.filter(F.col(name).isNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(content).orderBy(F.lit(0))))
    return some.select(*docs.columns, name).union(none.withColumn(name, late("_nth", content)).select(*docs.columns, name))


def dedup(docs: DataFrame, batches: int = 1, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that is left, UTF-8), a row for each input row.

    ``docs`` are judged in ``batches`` parts of ascending doc_id, each against those before it. A given ``index`` holds earlier
    documents, which needn't be read again, and holds these too when this returns. The result is read lazily.
    """
    rows = numbered(docs)
    if batches == 1:
        return judged(rows, index).drop("doc")
    index, keep = index or FingerprintIndex(docs.sparkSession), index is not None
    at = rows.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000).alias("at")).first()["at"] or []
    at = sorted(set(at))
    parts = [judged(rows.filter(((F.col("doc") > a) if a is not None else F.lit(True)) & ((F.col("doc") <= b) if b is not None else F.lit(True))), index, keep or b is not None) for a, b in zip([None, *at], [*at, None], strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.drop("doc")


def judged(docs: DataFrame, index: FingerprintIndex | None = None, keep: bool = True) -> DataFrame:
    """What ``dedup`` returns and doc, for one batch of documents that have a number in doc; ``keep``: the index gets them."""
    d = docs.select("doc", F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    keep = keep and index is not None
    index = index or FingerprintIndex(docs.sparkSession)
    run = index.run_of(d)
    total = docs.sparkSession.table(run).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(5, math.ceil(math.log2((_SPAN + 1) / 2 * max(1, total) / RANGE)))
    seen = index.seen(run)
    # one exchange of unique places and one of texts serve both passes, by way of the index's table where it keeps the texts
    unique = seen.filter("n = 1 and before = 0").groupBy("doc").agg(F.collect_list("pos").alias("unique"))
    with_unique = d.join(unique, "doc", "left").select("doc", "text", "unique", "doc_id")
    old = index.historical(seen, bits)
    if keep:
        with_unique = index.write_texts(with_unique)
    # all columns go in, as the exchange of texts is the second pass's own only if it has the same ones
    windows = with_unique.mapInArrow(partial(_window_rows, origin=BATCH, bits=bits), _RANGES)
    if old is not None:
        windows = windows.union(old)
    firsts = windows.groupBy("bucket").applyInArrow(_firsts, _FIRST)
    if keep:
        firsts = written(firsts, "substring-firsts")
        index.append(run, firsts)
    first = firsts.filter(F.col("origin") == BATCH).groupBy("doc").agg(F.collect_list("pos").alias("first"))
    rows = with_unique.join(first, "doc", "left").select("doc", "text", "unique", "first", "doc_id")
    return rows.mapInArrow(_decided, "doc bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), batches=2).drop("kept")


OP2_SQL = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from d),
k as (select doc_id, i, row_number() over (partition by array_to_string(w[i : i + {WINDOW - 1}], ' ') order by doc_id, i) as n from s),
g as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as j from k where n > 1),
r as (select doc_id, count(*) as n_removed, list(j) as gone from g group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, j: not list_contains(coalesce(gone, []), j)), ' '), '')) as kept_sha256
from d left join r using (doc_id)
"""
