"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins a word embedding (hashed) with the mean of its character trigrams' embeddings (hashed). Two
gated recurrent units read a window of ``WINDOW`` words forwards and backwards, attention pools their states and
a logistic unit scores the pool. A text's score comes from the mean and the highest of all its windows, which
overlap by half, and from their number, by a logistic regression.

Training is plain numpy on the driver, on at most about ``TRAIN_ROWS`` labelled rows of each label (by a hash of
doc_id) of up to ``TRAIN_WORDS`` words. A label says that some window is toxic, so each round learns from each
text's highest window as it stands, first by the log-odds of words, then by the network, and from one other of
each clean text.

Null and empty texts get the score of an empty window; without labels of both kinds every score is 0. Repeated
rows are scored alike; a null doc_id is passed through and counts as held in. A long text is scored in batches
of windows. Of documents only doc_id and text are read, of labels doc_id and toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import fold, table, words

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 12, 8, 8, 8
TRAIN_ROWS, TRAIN_WORDS = 2000, 1200
ROUNDS, STEPS, BATCH, RATE = 3, 250, 96, 0.02
PREDICTED = 0.7
#: Bytes of the heads of words, with a mark before them; texts that a word must be in for a row of its own.
HEADS, KNOWN = (5, 7, 9), 4
#: Bytes of a word that are hashed one by one.
LONG = 64
_CACHE, _CHUNK = 300_000, 2048
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>"
_M = np.uint64(0x9E3779B97F4A7C15)


def _features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: the row of the word embedding, all character rows, and where each word's start.

    Character rows are a word's trigrams and its first 4, 6 and 8 bytes.
    """
    marked = [b"<" + t + b">" for t in tokens]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    b = np.frombuffer(b"".join(marked) + b"  ", np.uint8).astype(np.uint64)
    tri = ((b[:-2] * _M ^ b[1:-1]) * _M ^ b[2:]) * _M >> np.uint64(64 - 12)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    n = np.maximum(size - 2, 1)
    poly, heads = np.zeros(len(tokens), np.uint64), []
    for k in range(min(LONG, int(size.max()) if len(size) else 0)):
        live = size > k
        poly[live] = (poly[live] ^ b[start[live] + k]) * _M
        poly[live] ^= poly[live] >> np.uint64(31)
        if k + 1 in HEADS:
            heads.append(poly >> np.uint64(64 - 12))
    while len(heads) < len(HEADS):
        heads.append(poly >> np.uint64(64 - 12))
    for i in np.flatnonzero(size > LONG):  # what is beyond is hashed at once
        poly[i] ^= np.uint64(xxhash.xxh3_64_intdigest(tokens[i]))
    own = np.concatenate([np.repeat(np.arange(len(tokens)), n), *[np.arange(len(tokens))] * len(HEADS)])
    rows = np.concatenate([tri[np.repeat(start, n) + _ranges(n)], *heads])
    order = np.argsort(own, kind="stable")
    return (poly >> np.uint64(64 - 14)).astype(np.intp), rows[order].astype(np.intp), np.concatenate(([0], np.cumsum(n + len(HEADS))[:-1])).astype(np.intp)


def _ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words without punctuation at their edges."""
    return [w.strip(_EDGE) for w in (text or b"").lower().split()]


def window_rows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's word rows; 0 pads."""
    n = max(1, -(-(len(ids) - STRIDE) // STRIDE))
    pad = np.zeros((n - 1) * STRIDE + WINDOW, ids.dtype)
    pad[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(pad, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Rows of words met so far; row 0 pads. ``project`` maps features of new words to whatever a row holds."""

    def __init__(self, project, width: int) -> None:
        self.project, self.width = project, width
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table, self.n = np.zeros((4096, self.width), np.float32), 1

    def rows(self, ws: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(ws) if w not in self.row]
        if new:
            while self.n + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[self.n : self.n + len(new)] = self.project(new)
            self.row.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return np.fromiter(map(self.row.__getitem__, ws), np.intp, len(ws))


class BiGru:
    """The weights, the forward pass over tables of projected words, and training with gradients through time."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * DIM
        self.known: frozenset[bytes] = frozenset()
        self.calibration = (np.zeros(3), np.ones(3), np.array([0.0, 0.0, 1.0, 0.0]))
        self.w = {"word": rng.normal(0, 0.1, (WORD_ROWS, DIM)), "char": rng.normal(0, 0.3, (CHAR_ROWS, DIM)), "a": rng.normal(0, 0.3, (2 * h, ATTEND)), "v": rng.normal(0, 0.3, ATTEND), "o": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        for s in "fb":
            self.w |= {f"i{s}": rng.normal(0, 0.4, (d, 3 * h)), f"u{s}": rng.normal(0, 0.3, (h, 3 * h)), f"n{s}": np.zeros(3 * h)}

    def embed(self, ws: list[bytes]) -> np.ndarray:
        word, tri, start = _features(ws)
        word = self._own(ws, word)
        n = np.diff(np.append(start, len(tri)))
        return np.concatenate((self.w["word"][word], np.add.reduceat(self.w["char"][tri], start, axis=0) / n[:, None]), 1)

    def _own(self, ws: list[bytes], word: np.ndarray) -> np.ndarray:
        """Rows of the word embedding: one for all words that training hardly met."""
        return np.where(np.fromiter(map(self.known.__contains__, ws), bool, len(ws)), word, 0)

    def text_score(self, mean: np.ndarray, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability that a text is toxic, from its windows' mean probability, highest score and number."""
        at, scale, w = self.calibration
        return _sigmoid(((_summary(mean, top, count) - at) / scale) @ w[:3] + w[3])

    def project(self, ws: list[bytes]) -> np.ndarray:
        """Each word's share of the gates' inputs, of both directions: all that the recurrence needs of it."""
        e = self.embed(ws)
        return np.concatenate([e @ self.w[f"i{s}"] + self.w[f"n{s}"] for s in "fb"], 1).astype(np.float32)

    def _states(self, p: np.ndarray, u: np.ndarray, order: range, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, (T, n, h); ``p``: gate inputs (T, n, 3h); padding leaves the state as it is."""
        h = np.zeros((p.shape[1], HIDDEN), p.dtype)
        out = np.empty((p.shape[0], *h.shape), p.dtype)
        for t in order:
            g = p[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]
            g = 1 / (1 + np.exp(-g))
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(p[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            out[t] = h = new
        return out

    def logits(self, ids: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """Scores of windows of rows of the projected table, before the logistic function."""
        at = np.ascontiguousarray(ids.T)
        mask = (at > 0).astype(np.float32)
        k, steps = 3 * HIDDEN, range(at.shape[0])
        w = {n: x.astype(np.float32) for n, x in self.w.items() if n in ("uf", "ub", "a", "v", "o", "c")}
        p = projected[at]
        h = np.concatenate((self._states(p[:, :, :k], w["uf"], steps, mask, None), self._states(p[:, :, k:], w["ub"], steps[::-1], mask, None)), 2)
        a = np.tanh(h @ w["a"]) @ w["v"] + np.where(mask > 0, 0, -30).astype(np.float32)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        return np.einsum("tn,tnh,h->n", a, h, w["o"]) + w["c"][0]

    def gradient(self, ids: np.ndarray, y: np.ndarray, feats: tuple) -> dict[str, np.ndarray]:
        """``ids``: windows of rows (0 pads) into ``feats``: word rows, trigram rows, their starts and counts."""
        used, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape).T
        word, tri, start, count = feats
        real = np.maximum(used - 1, 0)
        own = np.repeat(np.arange(len(used)), count[real])
        chars = tri[np.repeat(start[real], count[real]) + _ranges(count[real])]
        e = np.zeros((len(used), 2 * DIM))
        e[:, :DIM] = self.w["word"][word[real]]
        np.add.at(e[:, DIM:], own, self.w["char"][chars] / count[real][own][:, None])
        mask = (ids.T > 0).astype(float)
        x, n, steps = e[at], len(ids), range(WINDOW)
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._states(x @ self.w[f"i{s}"] + self.w[f"n{s}"], self.w[f"u{s}"], steps if s == "f" else steps[::-1], mask, kept[s]) for s in "fb"], 2)
        th = np.tanh(h @ self.w["a"])
        s = th @ self.w["v"] + np.where(mask > 0, 0, -30)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pool = np.einsum("tn,tnh->nh", a, h)
        d = (_sigmoid(pool @ self.w["o"] + self.w["c"][0]) - y) / n
        g = {"o": pool.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * self.w["o"]
        da = np.einsum("nh,tnh->tn", dpool, h)
        ds = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnk->k", ds, th)
        dth = ds[:, :, None] * self.w["v"] * (1 - th * th)
        g["a"] = np.einsum("tnh,tnk->hk", h, dth)
        dh = a[:, :, None] * dpool + dth @ self.w["a"].T
        dx = np.zeros_like(x)
        k = HIDDEN
        for i, sd in enumerate("fb"):
            u = self.w[f"u{sd}"]
            gi, gu, gn, carry = np.zeros_like(self.w[f"i{sd}"]), np.zeros_like(u), np.zeros(3 * k), np.zeros((n, k))
            for t, before, z, r, c in reversed(kept[sd]):
                dn, m = dh[t][:, i * k : (i + 1) * k] + carry, mask[t][:, None]
                dz, dc = dn * m * (c - before), dn * m * z
                gc = dc * (1 - c * c)
                drh = gc @ u[:, 2 * k :].T
                gates = np.concatenate((dz * z * (1 - z), drh * before * r * (1 - r), gc), 1)
                gi += x[t].T @ gates
                gn += gates.sum(0)
                gu[:, : 2 * k] += before.T @ gates[:, : 2 * k]
                gu[:, 2 * k :] += (r * before).T @ gc
                carry = dn * (1 - m * z) + gates[:, : 2 * k] @ u[:, : 2 * k].T + drh * r
                dx[t] += gates @ self.w[f"i{sd}"].T
            g |= {f"i{sd}": gi, f"u{sd}": gu, f"n{sd}": gn}
        de = np.zeros_like(e)
        np.add.at(de, at, dx * mask[:, :, None])
        g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
        np.add.at(g["word"], word[real], de[:, :DIM])
        np.add.at(g["char"], chars, de[own, DIM:] / count[real][own][:, None])
        return g

    def fit(self, texts: list[list[bytes]], y: np.ndarray, seed: int = 11) -> BiGru:
        """Learn the network from two thirds of the texts, and how windows make a text's score from the others."""
        rng = np.random.default_rng(seed)
        vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        every = [np.array([vocabulary[w] for w in t], np.int64) for t in texts]
        seen = np.zeros((2, len(vocabulary) + 1))
        part = rng.random(len(texts)) < 2 / 3
        for t, label in zip([t for t, p in zip(every, part, strict=True) if p], y[part].astype(int), strict=True):
            seen[label, np.unique(t)] += 1
        ws = list(vocabulary)
        self.known = frozenset(w for w, n in zip(ws, seen.sum(0)[1:], strict=True) if n >= KNOWN)
        word, tri, start = _features(ws)
        feats = (self._own(ws, word), tri, start, np.diff(np.append(start, len(tri))))
        odds = np.log((seen[1] + 0.2) / (y[part].sum() + 0.4)) - np.log((seen[0] + 0.2) / ((1 - y[part]).sum() + 0.4))
        odds[0] = 0
        wins, label = [window_rows(t) for t, p in zip(every, part, strict=True) if p], y[part]
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step = 0
        for r in range(ROUNDS):
            if r == 0:
                best = [int(np.maximum(odds[w], 0).sum(1).argmax()) for w in wins]
            else:
                best = [int(x.argmax()) for x in self._window_scores(wins, ws)]
            x = np.array([w[b] for w, b in zip(wins, best, strict=True)] + [w[rng.integers(len(w))] for w, bad in zip(wins, label, strict=True) if not bad])
            t = np.concatenate((label, np.zeros(int((1 - label).sum()))))
            pos, neg = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
            for _ in range(STEPS):  # a third of each batch is toxic
                step += 1
                at = np.concatenate((rng.choice(pos, BATCH // 3), rng.choice(neg, BATCH - BATCH // 3)))
                for k, g in self.gradient(x[at], t[at], feats).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        rest = ~part if 0 < y[~part].sum() < (~part).sum() else part
        scores = self._window_scores([window_rows(t) for t, p in zip(every, rest, strict=True) if p], ws)
        f = _summary(np.array([_sigmoid(x).mean() for x in scores]), np.array([x.max() for x in scores]), np.array([len(x) for x in scores]))
        at, scale, w = f.mean(0), f.std(0) + 1e-6, np.zeros(4)
        f = np.concatenate(((f - at) / scale, np.ones((len(f), 1))), 1)
        for _ in range(50):  # Newton's steps of a logistic regression with a small ridge
            p = _sigmoid(f @ w)
            ridge = np.diag([0.1, 0.1, 0.1, 1e-6])
            w -= np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + ridge, f.T @ (p - y[rest]) + ridge @ w)
        self.calibration = (at, scale, w)
        return self

    def _window_scores(self, wins: list[np.ndarray], ws: list[bytes]) -> list[np.ndarray]:
        flat = self.logits(np.concatenate(wins), np.concatenate((np.zeros((1, 6 * HIDDEN), np.float32), self.project(ws))))
        return np.split(flat, np.cumsum([len(w) for w in wins])[:-1])


def _summary(mean: np.ndarray, top: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack((np.log(mean + 1e-3), np.clip(top, -8, 8), np.log(count)), 1)


def train(docs: DataFrame, labels: DataFrame) -> BiGru | None:
    """The network, learned from a bounded sample of the labelled rows outside fold 1 of 3."""
    of = labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in of.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return None
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    some = of.filter(u < F.when(F.col("toxic") == 1, F.lit(min(1.0, TRAIN_ROWS / n[1]))).otherwise(F.lit(min(1.0, TRAIN_ROWS / n[0]))))
    some = some.orderBy(u, "doc_id").limit(3 * TRAIN_ROWS)
    found = docs.select("doc_id", "text").filter("text is not null").filter(F.length("text") <= 12 * TRAIN_WORDS).filter(F.size(words(F.col("text"))) <= TRAIN_WORDS)
    rows = found.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "text").limit(3 * TRAIN_ROWS).collect()
    y = np.array([float(r["toxic"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return BiGru().fit([tokens(r["text"].encode()) or [b""] for r in rows], y)


def _scored(batches: Iterator[pa.RecordBatch], net: BiGru | None) -> Iterator[pa.RecordBatch]:
    known = Vocabulary(net.project, 6 * HIDDEN) if net else None
    for b in batches:
        top, mass, count = np.full(b.num_rows, -np.inf), np.zeros(b.num_rows), np.zeros(b.num_rows)
        ready: list[tuple[np.ndarray, int]] = []
        held = 0

        def flush() -> None:
            if ready:
                x = np.concatenate([w for w, _ in ready])
                of = np.repeat([i for _, i in ready], [len(w) for w, _ in ready])
                for k in range(0, len(x), _CHUNK):
                    found, at = net.logits(x[k : k + _CHUNK], known.table), of[k : k + _CHUNK]
                    np.maximum.at(top, at, found)
                    np.add.at(mass, at, _sigmoid(found))
                np.add.at(count, of, 1)
                ready.clear()

        if net:
            for i, t in enumerate(b.column(2)):
                w = window_rows(known.rows(tokens(t.as_py())))
                ready.append((w, i))
                held += len(w)
                if held >= 4 * _CHUNK or known.n > _CACHE:
                    flush()
                    held = 0
                    if known.n > _CACHE:
                        known.clear()
            flush()
        score = net.text_score(mass / count, top, count) if net and b.num_rows else np.zeros(b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= PREDICTED).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each input row."""
    net = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_scored, net=net), "doc_id bigint, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
