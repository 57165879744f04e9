"""Graph networks against plain forward passes, finite differences, and what training must reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import training
from meshwright.operators.training import Network

EDGES = {"a": [(0, 1), (1, 2), (2, 0), (2, 3)], "b": [(0, 1), (1, 2)]}
SIZES = {"a": 5, "b": 3}  # node 4 of a has no edge


def graphs(spark, inputs, edge_inputs, seed=0):
    rng = np.random.default_rng(seed)
    x = {s: rng.normal(size=(n, inputs)) for s, n in SIZES.items()}
    y = {s: np.stack([v[:, 0] - v[:, 1], 0.5 * v[:, 0]], axis=1) for s, v in x.items()}
    e = {s: {p: rng.normal(size=edge_inputs) for u, v in pairs for p in ((u, v), (v, u))} for s, pairs in EDGES.items()}
    nodes = spark.createDataFrame([(s, n, x[s][n].tolist(), y[s][n].tolist()) for s in x for n in range(SIZES[s])], "sample_id string, node bigint, x array<double>, y array<double>")
    edges = spark.createDataFrame([(s, u, v, a.tolist()) for s in e for (u, v), a in e[s].items()], "sample_id string, source bigint, target bigint, attr array<double>")
    return x, y, e, nodes, edges


def plain(network, w, x, e):
    """A graph at once, node by node."""
    relu = lambda v: np.maximum(v, 0)
    dense = lambda v, name: v @ w[f"{name}.w"] + w[f"{name}.b"]

    def norm(v, name):
        return (v - v.mean(-1, keepdims=True)) / np.sqrt(v.var(-1, keepdims=True) + 1e-5) * w[f"{name}.g"] + w[f"{name}.s"]

    def chain(v, name, n, last=False):
        for k in range(n):
            v = dense(v, f"{name}.{k}")
            v = relu(v) if last or k + 1 < n else v
        return v

    if network.kind == "mlp":
        return chain(chain(x, "in", 3, True), "head", 1)
    if network.kind == "sum":
        net = lambda v, name, n=2: norm(chain(v, name, n, True), f"{name}.norm")
        h, a = net(x, "in"), {p: net(v, "edges") for p, v in e.items()}
        for _ in range(network.steps):
            m = np.zeros_like(h)
            for (s, t), v in a.items():
                m[t] += net(np.concatenate((h[t], h[s], v)), "message")
            a = {(s, t): v + net(np.concatenate((h[s], h[t], v)), "message") for (s, t), v in a.items()}
            h = h + net(np.concatenate((m, h), axis=1), "update")
        return chain(h, "head", 2)
    h = relu(dense(x, "in.0")) if network.kind == "sage" else chain(x, "in", 2)
    for k in range(network.steps):
        m = np.zeros_like(h)
        for n in range(len(x)):
            into = [(s, v) for (s, t), v in e.items() if t == n]
            sent = [h[s] if network.kind == "sage" else chain(np.concatenate((h[n], h[s], v)), f"message{k}", 2, True) for s, v in into]
            m[n] = np.mean(sent, axis=0) if sent else 0
        h = norm(h + (relu(dense(m, f"near{k}") + dense(h, f"own{k}")) if network.kind == "sage" else chain(np.concatenate((h, m), axis=1), f"update{k}", 2)), f"norm{k}")
    return chain(h, "head", 2 if network.kind == "sage" else 3)


NETWORKS = [Network("mlp", 3, 2, 6), Network("sage", 3, 2, 4, 2), Network("edge", 3, 2, 4, 2), Network("sum", 3, 2, 4, 2)]


@pytest.mark.parametrize("network", [*NETWORKS, Network("sum", 3, 2, 4, 15)], ids=lambda n: f"{n.kind}{n.steps}")
def test_forward_equals_numpy(spark, network):
    x, _, e, nodes, edges = graphs(spark, 3, 2)
    w = network.weights(3)
    w = {k: v + 0.1 * np.random.default_rng(1).normal(size=v.shape) for k, v in w.items()}
    got = {(r["sample_id"], r["node"]): r["p"] for r in training.predict(network, w, nodes, edges).collect()}
    assert len(got) == sum(SIZES.values())
    for s in x:
        for n, p in enumerate(plain(network, w, x[s], e[s])):
            assert got[s, n] == pytest.approx(p, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("network", NETWORKS, ids=lambda n: n.kind)
@pytest.mark.parametrize("kind", ["mse", "l1"])
def test_gradients_equal_differences(spark, network, kind):
    if kind == "l1" and network.kind != "sage":
        pytest.skip("one network shows the other loss")
    x, y, e, nodes, edges = graphs(spark, 3, 2)
    w = network.weights(3)
    _, grads = training.loss_and_gradients(network, w, nodes, training.prepared(network, edges), kind)
    assert set(grads) == set(w)

    def loss(weights):
        d = [plain(network, weights, x[s], e[s]) - y[s] for s in x]
        return np.mean([((v**2) if kind == "mse" else abs(v)).mean() for v in d])

    rng = np.random.default_rng(4)
    for name, v in w.items():
        for _ in range(2):
            at = tuple(rng.integers(n) for n in v.shape)
            moved = [{**w, name: v.copy()} for _ in range(2)]
            moved[0][name][at] += 1e-6
            moved[1][name][at] -= 1e-6
            assert grads[name][at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-6, rel=1e-4, abs=1e-7), name


def test_training_beats_the_mean_and_goes_on_where_it_stopped(spark, tmp_path):
    _, y, _, nodes, edges = graphs(spark, 3, 2)
    network, steps = Network("mlp", 3, 2, 8), training.Protocol(rate=0.05, epochs=12)
    mean = np.concatenate(list(y.values()))
    whole = training.train(network, steps, nodes, nodes, edges, str(tmp_path / "whole")).orderBy("epoch").collect()
    assert [r["epoch"] for r in whole] == list(range(1, 13)) and whole[-1]["best"] < ((mean - mean.mean(0)) ** 2).mean()
    training.train(network, training.Protocol(rate=0.05, epochs=5), nodes, nodes, edges, str(tmp_path / "parts"))
    parts = training.train(network, steps, nodes, nodes, edges, str(tmp_path / "parts")).orderBy("epoch").collect()
    assert [(r["epoch"], r["rate"]) for r in parts] == [(r["epoch"], r["rate"]) for r in whole]
    assert [r["val_loss"] for r in parts] == pytest.approx([r["val_loss"] for r in whole], rel=1e-9)
    best = training.best_weights(spark, str(tmp_path / "whole"), "run")
    assert training.evaluated(network, best, nodes, training.prepared(network, edges)) == pytest.approx(whole[-1]["best"])


def test_batches_plateau_and_early_stop(spark, tmp_path):
    _, _, _, nodes, edges = graphs(spark, 3, 2)
    network = Network("mlp", 3, 2, 4)
    still = training.Protocol(rate=0.0, batch=1, epochs=9, patience=3, hold=1, least_rate=0.0)
    rows = training.train(network, still, nodes, nodes, edges, str(tmp_path / "still")).orderBy("epoch").collect()
    assert len(rows) == 4 and [r["bad"] for r in rows] == [0, 1, 2, 3] and rows[-1]["steps"] == 8  # two samples, one a step
    moved = training.train(network, training.Protocol(loss="l1", rate=0.01, decoupled=False, decay=1e-3, schedule="decay", gamma=0.5, epochs=2), nodes, nodes, edges, str(tmp_path / "moved"))
    assert [r["rate"] for r in moved.orderBy("epoch").collect()] == [0.01, 0.005]


def test_a_step_of_adam():
    w = {"a": np.array([1.0, -2.0])}
    state = training.State(0, dict(w), {"a": np.zeros(2)}, {"a": np.zeros(2)}, 0, 0.1)
    training.stepped(state, {"a": np.array([30.0, 40.0])}, training.Protocol(decay=0.5))  # clipped from 50 to 5: (3, 4)
    assert state.weights["a"] == pytest.approx(w["a"] * (1 - 0.05) - 0.1, abs=1e-6)
    assert state.first["a"] == pytest.approx([0.3, 0.4], rel=1e-6)


def test_an_edge_network_learns(spark):
    _, _, _, nodes, edges = graphs(spark, 3, 2)
    before, after, passed = training.gate(Network("edge", 3, 2, 6, 1), training.Protocol(rate=0.02), nodes, edges, steps=6, fall=0.99)
    assert passed and after < before
    with pytest.raises(ValueError):
        Network("other", 3).weights()
    assert training.predict(Network("mlp", 3), Network("mlp", 3).weights(), nodes.limit(0)).count() == 0
    assert training.predict(Network("mlp", 3), Network("mlp", 3).weights(), nodes.withColumn("extra", F.lit(1))).count() == 8
