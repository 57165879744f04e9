"""Graph networks over node and edge tables: forward passes, back-propagation and training.

Nodes are rows (sample_id, node, x), edges directed rows (sample_id, source, target, attr), each pair once. States move between
both by joins and grouped sums; what happens to a row alone (dense layers, rectifiers, norms) runs in numpy, a batch of rows
at a time. Back-propagation goes the same way in reverse: a row's part is computed anew from what its layer read,
which the forward pass has written, and gradients of weights are summed in each task, then in a tree. So no task holds a
graph, and the driver holds weights, never rows.

Four kinds of network share the scheme of encoder, layers and head:

- ``mlp``: three dense layers and a head over node features; edges are not read.
- ``sage``: neighbours' mean and own state through dense layers, rectified, added, normalised; a rectified input layer.
- ``edge``: messages of target, source and edge, averaged; a residual update, normalised.
- ``sum``: messages of target, source and edge states are added up; nodes and edges have residual updates, by one set of weights
  for all its layers.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.shared import written

Weights = dict[str, np.ndarray]


class Tape:
    """Values of a forward pass over the rows of a batch, and how to go back through them."""

    def __init__(self, weights: Weights):
        self.weights, self.grads, self.back = weights, {}, []

    def leaf(self, value: np.ndarray) -> Value:
        return Value(value)

    def backward(self, *ends: tuple[Value, np.ndarray]) -> None:
        for v, d in ends:
            v.add(d)
        for step in reversed(self.back):
            step()

    def _weight(self, name: str, d: np.ndarray) -> None:
        self.grads[name] = self.grads[name] + d if name in self.grads else d

    def dense(self, x: Value, name: str) -> Value:
        w, b = self.weights[f"{name}.w"], self.weights[f"{name}.b"]
        out = Value(x.value @ w + b)

        def step() -> None:
            if out.grad is not None:
                self._weight(f"{name}.w", x.value.T @ out.grad)
                self._weight(f"{name}.b", out.grad.sum(axis=0))
                x.add(out.grad @ w.T)

        self.back.append(step)
        return out

    def relu(self, x: Value) -> Value:
        out = Value(np.maximum(x.value, 0))
        self.back.append(lambda: out.grad is not None and x.add(out.grad * (x.value > 0)))
        return out

    def norm(self, x: Value, name: str, epsilon: float = 1e-5) -> Value:
        centred = x.value - x.value.mean(axis=1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + epsilon)
        z = centred * scale
        out = Value(z * self.weights[f"{name}.g"] + self.weights[f"{name}.s"])

        def step() -> None:
            if out.grad is not None:
                self._weight(f"{name}.g", (out.grad * z).sum(axis=0))
                self._weight(f"{name}.s", out.grad.sum(axis=0))
                d = out.grad * self.weights[f"{name}.g"]
                x.add(scale * (d - d.mean(axis=1, keepdims=True) - z * (d * z).mean(axis=1, keepdims=True)))

        self.back.append(step)
        return out

    def add(self, a: Value, b: Value) -> Value:
        out = Value(a.value + b.value)
        self.back.append(lambda: out.grad is not None and (a.add(out.grad), b.add(out.grad)))
        return out

    def concat(self, *parts: Value) -> Value:
        out = Value(np.concatenate([p.value for p in parts], axis=1))
        cuts = np.cumsum([p.value.shape[1] for p in parts])[:-1]

        def step() -> None:
            if out.grad is not None:
                for p, d in zip(parts, np.split(out.grad, cuts, axis=1), strict=True):
                    p.add(d)

        self.back.append(step)
        return out

    def layers(self, x: Value, name: str, n: int, last: bool = False) -> Value:
        """n dense layers with rectifiers between them, and after the last if asked."""
        for k in range(n):
            x = self.dense(x, f"{name}.{k}")
            x = self.relu(x) if last or k + 1 < n else x
        return x


class Value:
    def __init__(self, value: np.ndarray):
        self.value, self.grad = value, None

    def add(self, d: np.ndarray) -> None:
        self.grad = d if self.grad is None else self.grad + d


@dataclass(frozen=True)
class Network:
    """A network's kind and sizes. Inputs are those of a node, features of its sample included."""

    kind: str
    inputs: int
    edge_inputs: int = 0
    hidden: int = 128
    steps: int = 4
    outputs: int = 2

    def weights(self, seed: int = 0) -> Weights:
        """Uniform within 1 / sqrt(inputs) of a layer, as is usual for dense layers; norms start as they are."""
        rng, out, h = np.random.default_rng(seed), {}, self.hidden

        def dense(name: str, a: int, b: int) -> None:
            out[f"{name}.w"] = rng.uniform(-1, 1, (a, b)) / math.sqrt(a)
            out[f"{name}.b"] = rng.uniform(-1, 1, b) / math.sqrt(a)

        def chain(name: str, *sizes: int) -> None:
            for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
                dense(f"{name}.{k}", a, b)

        def norm(name: str) -> None:
            out[f"{name}.g"], out[f"{name}.s"] = np.ones(h), np.zeros(h)

        if self.kind == "mlp":
            chain("in", self.inputs, h, h, h // 2)
            chain("head", h // 2, self.outputs)
        elif self.kind == "sage":
            chain("in", self.inputs, h)
            for k in range(self.steps):
                dense(f"near{k}", h, h)
                dense(f"own{k}", h, h)
                norm(f"norm{k}")
            chain("head", h, h, self.outputs)
        elif self.kind == "edge":
            chain("in", self.inputs, h, h)
            for k in range(self.steps):
                chain(f"message{k}", 2 * h + self.edge_inputs, h, h)
                chain(f"update{k}", 2 * h, h, h)
                norm(f"norm{k}")
            chain("head", h, h, h // 2, self.outputs)
        elif self.kind == "sum":
            for name, a in (("in", self.inputs), ("edges", self.edge_inputs), ("message", 3 * h), ("update", 2 * h)):
                chain(name, a, h, h)
                norm(f"{name}.norm")
            chain("head", h, h, self.outputs)
        else:
            raise ValueError(f"no network of kind {self.kind}")
        return out

    @property
    def rounds(self) -> int:
        return 0 if self.kind == "mlp" else self.steps

    def encode(self, t: Tape, x: Value) -> Value:
        if self.kind == "sum":
            return t.norm(t.layers(x, "in", 2, last=True), "in.norm")
        return t.layers(x, "in", {"mlp": 3, "sage": 1, "edge": 2}[self.kind], last=self.kind != "edge")

    def encode_edges(self, t: Tape, e: Value) -> Value:
        return t.norm(t.layers(e, "edges", 2, last=True), "edges.norm") if self.kind == "sum" else e

    def message(self, t: Tape, k: int, target: Value, source: Value, e: Value) -> tuple[Value, Value]:
        """What an edge sends, and its own next state."""
        if self.kind == "sage":
            return source, e
        if self.kind == "edge":
            return t.layers(t.concat(target, source, e), f"message{k}", 2, last=True), e
        net = lambda *x: t.norm(t.layers(t.concat(*x), "message", 2, last=True), "message.norm")
        return net(target, source, e), t.add(e, net(source, target, e))

    def update(self, t: Tape, k: int, h: Value, m: Value) -> Value:
        if self.kind == "sage":
            return t.norm(t.add(h, t.relu(t.add(t.dense(m, f"near{k}"), t.dense(h, f"own{k}")))), f"norm{k}")
        if self.kind == "edge":
            return t.norm(t.add(h, t.layers(t.concat(h, m), f"update{k}", 2)), f"norm{k}")
        return t.add(h, t.norm(t.layers(t.concat(m, h), "update", 2, last=True), "update.norm"))

    def head(self, t: Tape, h: Value) -> Value:
        return t.layers(h, "head", {"mlp": 1, "sage": 2, "edge": 3, "sum": 2}[self.kind])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _packed(weights: Weights) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    return buffer.getvalue()


def _unpacked(content: bytes) -> Weights:
    with np.load(io.BytesIO(content)) as z:
        return {k: z[k] for k in z.files}


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def mapped(df: DataFrame, keep: list[str], reads: list[str], makes: list[str], row: Callable[..., list[np.ndarray]]) -> DataFrame:
    """The columns ``keep`` and arrays ``makes``, which ``row`` makes of the arrays ``reads`` of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *map(_lists, row(*[_matrix(b.column(c)) for c in reads]))], [*keep, *makes])

    return df.select(*keep, *reads).mapInArrow(run, ", ".join([_ddl(df, *keep), *[f"{c} array<double>" for c in makes]]))


def reversed_(df: DataFrame, keep: list[str], reads: list[str], makes: list[str], row: Callable[..., tuple[list[np.ndarray], Weights]]) -> tuple[DataFrame, DataFrame]:
    """As ``mapped``, where ``row`` also gives gradients of weights: the rows, and a table of each task's summed gradients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Weights = {}
        schema = None
        for b in batches:
            if b.num_rows:
                made, grads = row(*[_matrix(b.column(c)) for c in reads])
                total = {k: total[k] + grads[k] if k in total and k in grads else total.get(k, grads.get(k)) for k in {*total, *grads}}
                out = pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *map(_lists, made), pa.nulls(b.num_rows, pa.binary())], [*keep, *makes, "grads"])
                schema = out.schema
                yield out
        if total:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(schema)[:-1]], pa.array([_packed(total)], pa.binary())], schema.names)

    out = df.select(*keep, *reads).mapInArrow(run, ", ".join([_ddl(df, *keep), *[f"{c} array<double>" for c in makes], "grads binary"]))
    out = written(out, "net-back")
    return out.filter("grads is null").drop("grads"), out.filter("grads is not null").select("grads")


def _summed(df: DataFrame, by: list[str], name: str, width: int) -> DataFrame:
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)]).alias(name))


def _merged(a: Weights, b: Weights) -> Weights:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}


def _gradients(tables: list[DataFrame]) -> Weights:
    every = reduce(DataFrame.union, tables)
    return every.rdd.treeAggregate({}, lambda a, r: _merged(a, _unpacked(bytes(r[0]))), _merged)


_NODE, _EDGE = ["sample_id", "node"], ["sample_id", "source", "target"]


def prepared(network: Network, edges: DataFrame) -> DataFrame:
    """Edges with ``share``, what a message counts for at its target: an equal part of a mean, or 1 of a sum. Written once for all passes."""
    if network.kind == "sum":
        return written(edges.select(*_EDGE, "attr", F.lit(1.0).alias("share")), "net-edges")
    n = edges.groupBy("sample_id", "target").agg((1 / F.count(F.lit(1))).alias("share"))
    return written(edges.select(*_EDGE, "attr").join(n, ["sample_id", "target"]).select(*_EDGE, "attr", "share"), "net-edges")


class Pass:
    """A forward pass, with what a way back needs: what each layer's edges and nodes read."""

    def __init__(self, network: Network, weights: Weights, nodes: DataFrame, edges: DataFrame, keep: bool):
        self.network, self.nodes, self.edges, self.keep = network, nodes, edges, keep
        self.held = nodes.sparkSession.sparkContext.broadcast(weights)
        self.read: list[tuple[DataFrame, DataFrame]] = []
        h = self._rows(nodes, _NODE, ["x"], ["h"], lambda t, x: [network.encode(t, x)])
        e = edges
        if network.kind == "sum":
            e = self._rows(edges, [*_EDGE, "share"], ["attr"], ["attr"], lambda t, x: [network.encode_edges(t, x)])
        for k in range(network.rounds):
            h, e = self._layer(k, h, e)
        self.h = written(h, "net-states") if keep else h
        self.predicted = self._rows(self.h, _NODE, ["h"], ["p"], lambda t, x: [network.head(t, x)])

    def _rows(self, df: DataFrame, keep: list[str], reads: list[str], makes: list[str], make: Callable) -> DataFrame:
        held = self.held

        def row(*arrays: np.ndarray) -> list[np.ndarray]:
            t = Tape(held.value)
            return [v.value for v in make(t, *map(t.leaf, arrays))]

        return mapped(df, keep, reads, makes, row)

    def _layer(self, k: int, h: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        network = self.network
        # every layer's states are written to train, else every third's
        h = written(h, "net-states") if self.keep or k % 3 == 2 else h
        e = written(e, "net-edge-states") if network.kind == "sum" and (self.keep or k % 3 == 2) else e
        end = lambda to, name: h.select("sample_id", F.col("node").alias(to), F.col("h").alias(name))
        g = e.join(end("source", "hs"), ["sample_id", "source"]).join(end("target", "ht"), ["sample_id", "target"])
        g = written(g, "net-ends") if self.keep else g
        sent = self._rows(g, [*_EDGE, "share"], ["ht", "hs", "attr"], ["m", "attr"], lambda t, *x: list(network.message(t, k, *x)))
        sent = written(sent, "net-sent") if self.keep and network.kind == "sum" else sent
        m = _summed(sent.select("sample_id", F.col("target").alias("node"), F.transform("m", lambda v: v * F.col("share")).alias("m")), _NODE, "m", network.hidden)
        u = h.join(m, _NODE, "left").select(*_NODE, "h", F.coalesce("m", F.array_repeat(F.lit(0.0), network.hidden)).alias("m"))
        u = written(u, "net-nodes") if self.keep else u
        self.read.append((g, u))
        return self._rows(u, _NODE, ["h", "m"], ["h"], lambda t, *x: [network.update(t, k, *x)]), sent.select(*_EDGE, "share", "attr") if network.kind == "sum" else e

    def _back(self, df: DataFrame, keep: list[str], reads: list[str], given: list[str], makes: list[str], make: Callable) -> tuple[DataFrame, DataFrame]:
        """Gradients of the arrays ``reads`` (as ``makes``), from those of what ``make`` makes of them (``given``)."""
        held, n = self.held, len(reads)

        def row(*arrays: np.ndarray) -> tuple[list[np.ndarray], Weights]:
            t = Tape(held.value)
            leaves = [t.leaf(a) for a in arrays[:n]]
            t.backward(*zip(make(t, *leaves), arrays[n:], strict=True))
            return [np.zeros_like(v.value) if v.grad is None else v.grad for v in leaves], t.grads

        return reversed_(df, keep, [*reads, *given], makes, row)

    def gradients(self, d: DataFrame) -> Weights:
        """Gradients of the weights, from those of the predictions (sample_id, node, d)."""
        net, h = self.network, self.network.hidden
        rows, grads = self._back(self.h.join(d, _NODE), _NODE, ["h"], ["d"], ["dh"], lambda t, x: [net.head(t, x)])
        tables, de = [grads], None
        for k in reversed(range(net.rounds)):
            g, u = self.read[k]
            own, grads = self._back(u.join(rows, _NODE), _NODE, ["h", "m"], ["dh"], ["dh", "dm"], lambda t, *x, k=k: [net.update(t, k, *x)])
            tables.append(grads)
            at = g.join(own.select("sample_id", F.col("node").alias("target"), "dm"), ["sample_id", "target"]).withColumn("dm", F.transform("dm", lambda v: v * F.col("share")))
            if de is not None:
                at = at.join(de, _EDGE)
            given = ["dm", "de"] if de is not None else ["dm"]
            back, grads = self._back(at, _EDGE, ["ht", "hs", "attr"], given, ["dt", "ds", "de"], lambda t, *x, k=k, n=len(given): list(net.message(t, k, *x))[:n])
            tables.append(grads)
            de = back.select(*_EDGE, "de") if net.kind == "sum" else None
            part = lambda to, c: back.select("sample_id", F.col(to).alias("node"), F.col(c).alias("dh"))  # noqa: B023, E731
            rows = written(_summed(own.select(*_NODE, "dh").union(part("target", "dt")).union(part("source", "ds")), _NODE, "dh", h), "net-back")
        tables.append(self._back(self.nodes.join(rows, _NODE), _NODE, ["x"], ["dh"], ["dx"], lambda t, x: [net.encode(t, x)])[1])
        if net.kind == "sum":
            tables.append(self._back(self.edges.join(de, _EDGE), _EDGE, ["attr"], ["de"], ["da"], lambda t, x: [net.encode_edges(t, x)])[1])
        return _gradients(tables)


def predict(network: Network, weights: Weights, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(sample_id, node, p): the network's outputs for every node. ``edges`` as read, or as ``prepared``."""
    if edges is None:
        edges = nodes.select("sample_id", F.col("node").alias("source"), F.col("node").alias("target"), F.col("x").alias("attr")).limit(0)
    return Pass(network, weights, nodes.select(*_NODE, "x"), edges if "share" in edges.columns else prepared(network, edges), keep=False).predicted


def _loss(kind: str, p: Column, y: Column) -> tuple[Column, Column]:
    """A row's sum of losses, and their gradients."""
    each = F.zip_with(p, y, lambda a, b: (a - b) * (a - b) if kind == "mse" else F.abs(a - b))
    slope = F.zip_with(p, y, lambda a, b: 2 * (a - b) if kind == "mse" else F.signum(a - b))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v), slope


def loss_and_gradients(network: Network, weights: Weights, nodes: DataFrame, edges: DataFrame, kind: str = "mse", graphs: int | None = None) -> tuple[float, Weights]:
    """The mean loss over all outputs, and the gradients of the sum of the samples' mean losses over ``graphs`` (their number)."""
    p = Pass(network, weights, nodes.select(*_NODE, "x"), edges, keep=True)
    size = nodes.groupBy("sample_id").agg((1 / (F.count(F.lit(1)) * network.outputs)).alias("_part"))
    graphs = graphs or size.count()
    total, slope = _loss(kind, F.col("p"), F.col("y"))
    rows = p.predicted.join(nodes.select(*_NODE, "y"), _NODE).join(size, "sample_id")
    rows = written(rows.select(*_NODE, total.alias("loss"), F.transform(slope, lambda v: v * F.col("_part") / graphs).alias("d")), "net-loss")
    loss = rows.agg(F.sum("loss") / (F.count(F.lit(1)) * network.outputs)).first()[0]
    return loss, p.gradients(rows.select(*_NODE, "d"))


def evaluated(network: Network, weights: Weights, nodes: DataFrame, edges: DataFrame, kind: str = "mse") -> float:
    """The mean loss over all outputs of all nodes."""
    total, _ = _loss(kind, F.col("p"), F.col("y"))
    rows = predict(network, weights, nodes, edges).join(nodes.select(*_NODE, "y"), _NODE)
    return rows.agg(F.sum(total) / (F.count(F.lit(1)) * network.outputs)).first()[0]


@dataclass(frozen=True)
class Protocol:
    """How to train. ``schedule``: plateau (halve the rate after ``hold`` epochs without a better validation loss) or decay (by ``gamma`` an epoch)."""

    loss: str = "mse"
    rate: float = 1e-3
    decay: float = 1e-5
    decoupled: bool = True
    clip: float = 5.0
    schedule: str = "plateau"
    factor: float = 0.5
    hold: int = 10
    least_rate: float = 1e-5
    gamma: float = 0.9
    batch: int | None = None
    patience: int = 35
    min_delta: float = 1e-4
    epochs: int = 300
    seed: int = 0


#: The two protocols (fixed values): AdamW on squared errors with a plateau, and Adam on absolute errors with decay. ``batch`` is in samples.
MATCHED = Protocol(batch=4)
PAPER = Protocol(loss="l1", rate=0.01, decay=5e-4, decoupled=False, schedule="decay", batch=1, patience=45)


@dataclass
class State:
    """What training goes on from: everything that a ledger row holds."""

    epoch: int
    weights: Weights
    first: Weights
    second: Weights
    steps: int
    rate: float
    best: float = math.inf
    best_epoch: int = -1
    bad: int = 0
    plateau_best: float = math.inf
    plateau_bad: int = 0


def stepped(state: State, grads: Weights, protocol: Protocol) -> None:
    """One step of Adam, with decay beside the gradient (decoupled) or within it; gradients are clipped by their common norm."""
    norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
    cut = min(1.0, protocol.clip / (norm + 1e-6))
    state.steps += 1
    for k, w in state.weights.items():
        g = grads.get(k, np.zeros_like(w)) * cut
        if protocol.decoupled:
            w = w * (1 - state.rate * protocol.decay)
        else:
            g = g + protocol.decay * w
        state.first[k] = 0.9 * state.first[k] + 0.1 * g
        state.second[k] = 0.999 * state.second[k] + 0.001 * g * g
        m, v = state.first[k] / (1 - 0.9**state.steps), state.second[k] / (1 - 0.999**state.steps)
        state.weights[k] = w - state.rate * m / (np.sqrt(v) + 1e-8)


def _scheduled(state: State, loss: float, protocol: Protocol) -> None:
    if protocol.schedule == "decay":
        state.rate *= protocol.gamma
    elif loss < state.plateau_best * (1 - 1e-4):
        state.plateau_best, state.plateau_bad = loss, 0
    else:
        state.plateau_bad += 1
        if state.plateau_bad > protocol.hold:
            state.rate, state.plateau_bad = max(state.rate * protocol.factor, protocol.least_rate), 0


LEDGER = "run string, epoch int, train_loss double, val_loss double, rate double, next_rate double, steps int, best double, best_epoch int, bad int, plateau_best double, plateau_bad int, state binary"


def resumed(spark: SparkSession, path: str, run: str) -> State | None:
    """The state after the last epoch of a run that the ledger has; None if it has none."""
    if not _exists(spark, path):
        return None
    r = spark.read.schema(LEDGER).parquet(path).filter(F.col("run") == run).orderBy(F.desc("epoch")).first()
    if r is None:
        return None
    arrays = _unpacked(bytes(r["state"]))
    of = lambda kind: {k.split("/", 1)[1]: v for k, v in arrays.items() if k.startswith(f"{kind}/")}
    return State(r["epoch"], of("weights"), of("first"), of("second"), r["steps"], r["next_rate"], r["best"], r["best_epoch"], r["bad"], r["plateau_best"], r["plateau_bad"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def best_weights(spark: SparkSession, path: str, run: str) -> Weights:
    """The weights of the epoch with the run's best validation loss."""
    rows = spark.read.schema(LEDGER).parquet(path).filter(F.col("run") == run)
    r = rows.filter("best_epoch = epoch").orderBy(F.desc("epoch")).first()
    return {k.split("/", 1)[1]: v for k, v in _unpacked(bytes(r["state"])).items() if k.startswith("weights/")}


def train(network: Network, protocol: Protocol, train_nodes: DataFrame, val_nodes: DataFrame, edges: DataFrame, ledger: str, run: str = "run") -> DataFrame:
    """Train until the validation loss hasn't fallen by ``min_delta`` for ``patience`` epochs; the run's rows of the ledger, without states.

    ``train_nodes`` and ``val_nodes``: sample_id, node, x, y; ``edges``: those of both. A step takes ``batch`` samples, in an
    order that the seed and the epoch give; without a batch, all. Each epoch appends a row with the whole state to
    ``ledger``, so a run that was cut off goes on from its last epoch.
    """
    spark = train_nodes.sparkSession
    edges = prepared(network, edges)
    nodes, val = written(train_nodes.select(*_NODE, "x", "y"), "net-train"), written(val_nodes.select(*_NODE, "x", "y"), "net-val")
    state = resumed(spark, ledger, run)
    if state is None:
        w = network.weights(protocol.seed)
        zero = lambda: {k: np.zeros_like(v) for k, v in w.items()}
        state = State(0, w, zero(), zero(), 0, protocol.rate)
    samples = nodes.select("sample_id").distinct()
    n = samples.count()
    while state.epoch < protocol.epochs and state.bad < protocol.patience:
        state.epoch += 1
        rate, losses = state.rate, []
        if protocol.batch is None or protocol.batch >= n:
            batches = [(nodes, n)]
        else:  # samples are few, against their nodes: an order of theirs is a small table
            order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(protocol.seed), F.lit(state.epoch), "sample_id"), "sample_id"))
            dealt = written(samples.select("sample_id", F.floor((order - 1) / protocol.batch).alias("_b")), "net-order")
            batches = [(nodes.join(dealt.filter(F.col("_b") == b).select("sample_id"), "sample_id", "left_semi"), protocol.batch) for b in range(-(-n // protocol.batch))]
        for rows, graphs in batches:
            own = edges if len(batches) == 1 else edges.join(rows.select("sample_id").distinct(), "sample_id", "left_semi")
            loss, grads = loss_and_gradients(network, state.weights, rows, own, protocol.loss, graphs)
            if not math.isfinite(loss):
                raise RuntimeError(f"{run}: the training loss of epoch {state.epoch} is not finite")
            losses.append(loss * rows.count())
            stepped(state, grads, protocol)
        val_loss = evaluated(network, state.weights, val, edges, protocol.loss)
        _scheduled(state, val_loss, protocol)
        if val_loss < state.best - protocol.min_delta:
            state.best, state.best_epoch, state.bad = val_loss, state.epoch, 0
        else:
            state.bad += 1
        held = {f"{kind}/{k}": v for kind, of in (("weights", state.weights), ("first", state.first), ("second", state.second)) for k, v in of.items()}
        row = (run, state.epoch, sum(losses) / nodes.count(), val_loss, rate, state.rate, state.steps, state.best, state.best_epoch, state.bad, state.plateau_best, state.plateau_bad, _packed(held))
        spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("run") == run).drop("state")


def gate(network: Network, protocol: Protocol, nodes: DataFrame, edges: DataFrame, steps: int = 160, fall: float = 0.6) -> tuple[float, float, bool]:
    """Losses of a few samples before and after ``steps`` steps on them, and whether the latter is below ``fall`` times the former."""
    edges, nodes = prepared(network, edges), written(nodes.select(*_NODE, "x", "y"), "net-gate")
    w = network.weights(protocol.seed)
    state = State(0, w, {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0, protocol.rate)
    before = evaluated(network, w, nodes, edges, protocol.loss)
    for _ in range(steps):
        stepped(state, loss_and_gradients(network, state.weights, nodes, edges, protocol.loss)[1], protocol)
    after = evaluated(network, state.weights, nodes, edges, protocol.loss)
    return before, after, math.isfinite(after) and after < fall * before
