"""Language identification by a byte convolutional network.

Bytes (A-Z lower-cased) are embedded; filters of ``WIDTHS`` bytes slide over windows of ``WINDOW`` bytes; each
filter's maximum goes through a rectifier into a softmax. Training is plain numpy on the driver, over windows of
a sample of labelled rows: at most about ``PER_LANG`` rows of each language and ``TRAIN_ROWS`` in all, chosen by
a hash of doc_id. Tasks then apply the network to every window of every whole text; windows overlap by the
widest filter less one, so every byte sequence is seen. A text's prediction is the mean of its windows.

Texts that are null or have no letter (empty ones too) are ``und`` with score 0, as are all texts where nothing
is labelled. Repeated rows are judged alike; a null doc_id is passed through and counts as held in. A very long
text is cut into batches of windows. Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import fold, table

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
PER_LANG, TRAIN_ROWS, WINDOWS_PER_ROW = 600, 6000, 3
EPOCHS, BATCH, RATE = 4, 64, 0.01
_STRIDE = WINDOW - max(WIDTHS) + 1
_CHUNK = 128


def windows(text: bytes) -> np.ndarray:
    """A text's windows, zero-padded: (n, WINDOW) bytes."""
    x = np.frombuffer(text.lower(), np.uint8)
    n = max(1, -(-(len(x) - max(WIDTHS) + 1) // _STRIDE))
    pad = np.zeros((n - 1) * _STRIDE + WINDOW, np.uint8)
    pad[: len(x)] = x[: len(pad)]
    return np.lib.stride_tricks.sliding_window_view(pad, WINDOW)[::_STRIDE]


class ByteConvNet:
    """Weights of the network, and training by Adam on windows."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {"e": rng.normal(0, 0.3, (256, DIM)), "o": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))), "c": np.zeros(len(labels))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, 0.3, (k, DIM, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                for k, g in self._gradient(x[at], y[at]).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        best, pooled = {}, []
        for k, scores in self._convolved(x):
            best[k] = scores.argmax(1)
            pooled.append(np.take_along_axis(scores, best[k][:, None, :], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        p = _softmax(h @ self.w["o"] + self.w["c"])
        p[np.arange(n), y] -= 1
        p /= n
        g = {"o": h.T @ p, "c": p.sum(0), "e": np.zeros_like(self.w["e"])}
        dz = (p @ self.w["o"].T) * (z > 0)
        for i, k in enumerate(WIDTHS):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]  # only a filter's best place has a gradient
            g[f"b{k}"], g[f"f{k}"] = d.sum(0), np.zeros_like(self.w[f"f{k}"])
            for j in range(k):
                at = x[rows, best[k] + j]
                g[f"f{k}"][j] = np.einsum("bfd,bf->df", self.w["e"][at], d)
                np.add.at(g["e"], at, d[:, :, None] * self.w[f"f{k}"][j].T[None])
        return g

    def _convolved(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width, the filters' values at every place of every window, from tables of 256 rows."""
        at = x.astype(np.intp)
        for k in WIDTHS:
            tables = [(self.w["e"] @ self.w[f"f{k}"][j]).astype(np.float32) for j in range(k)]
            tables[0] += self.w[f"b{k}"].astype(np.float32)
            out = tables[0][at[:, : WINDOW - k + 1]]
            for j in range(1, k):
                out += tables[j][at[:, j : WINDOW - k + 1 + j]]
            yield k, out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([np.maximum(s.max(1), 0) for _, s in self._convolved(x)], 1)
        return np.log(np.maximum(_softmax(h @ self.w["o"] + self.w["c"]), 1e-12))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, out = [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = windows(text)
            for k in np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_ROW).astype(int)):
                lang.append(name)
                out.append(w[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "x"])


def train(docs: DataFrame) -> ByteConvNet | None:
    """The network, learned from text and lang of a bounded sample of labelled rows outside fold 1 of 3."""
    known = docs.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}")).filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", "lang", "text")
    rate = {r["lang"]: min(1.0, PER_LANG / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not rate:
        return None
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted(rate.items())], F.lit(0.0))
    some = known.filter(u < share).select("lang", F.col("text").cast("binary").alias("text"))
    rows = some.mapInArrow(_training_windows, "lang string, x binary").orderBy(F.xxhash64("x"), "lang").limit(TRAIN_ROWS * WINDOWS_PER_ROW).collect()
    labels = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet(labels).train(x, np.array([labels.index(r["lang"]) for r in rows]))


def _predicted(batches: Iterator[pa.RecordBatch], net: ByteConvNet | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        total, count = np.zeros((n, len(net.labels) if net else 1)), np.zeros(n)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            if not ready:
                return
            x, of = np.concatenate([r[0] for r in ready]), np.concatenate([r[1] for r in ready])
            for k in range(0, len(x), _CHUNK):
                np.add.at(total, of[k : k + _CHUNK], net.log_probabilities(x[k : k + _CHUNK]))
            np.add.at(count, of, 1)
            ready.clear()

        for i, (text, letter) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
            if letter and net:
                w = windows(text.as_py())
                ready.append((w, np.full(len(w), i)))
                held += len(w)
                if held >= 4096:
                    flush()
                    held = 0
        flush()
        known = count > 0
        p = _softmax(total / np.maximum(count, 1)[:, None])
        best = p.argmax(1)
        lang = [net.labels[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
        score = np.where(known, p[np.arange(n), best], 0.0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row for each input row."""
    net = train(docs)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("binary").alias("text"), letter.alias("letter"))
    return rows.mapInArrow(partial(_predicted, net=net), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
