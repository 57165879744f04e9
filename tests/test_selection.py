"""Frozen selections and timed tests of trained runs."""

import numpy as np
import pytest

from meshwright.operators import selection, training
from meshwright.operators.training import Network

NET = {"EdgeAwareGNN": Network("mlp", 2, 2, 3), "MLP": Network("mlp", 2, 2, 2)}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    x = {(s, n): rng.normal(size=2) for s in "abcd" for n in range(4)}
    nodes = spark.createDataFrame([(s, n, v.tolist(), [float(v.sum()), float(v[0])]) for (s, n), v in x.items()], "sample_id string, node bigint, x array<double>, y array<double>")
    edges = spark.createDataFrame([], "sample_id string, source bigint, target bigint, attr array<double>")
    ledger = str(tmp_path_factory.mktemp("ledger") / "runs")
    for run, epochs in (("EdgeAwareGNN", 1), ("MLP", 2)):
        training.train(NET[run], training.Protocol(rate=0.01, epochs=epochs), nodes.filter("sample_id = 'a'"), nodes.filter("sample_id = 'b'"), edges, ledger, run)
    return nodes.filter("sample_id in ('c', 'd')"), edges, ledger


def test_the_named_run_is_frozen_whatever_its_loss(spark, fixture, tmp_path):
    _, _, ledger = fixture
    runs = selection.compared(spark, ledger).orderBy("rank").collect()
    assert [r["rank"] for r in runs] == [1, 2] and {r["model"]: r["epochs_run"] for r in runs} == {"EdgeAwareGNN": 1, "MLP": 2}
    assert runs[0]["best_val_mse"] <= runs[1]["best_val_mse"]
    path = str(tmp_path / "frozen")
    row = selection.freeze(spark, ledger, path, "EdgeAwareGNN", seed=3).first()
    of = next(r for r in runs if r["model"] == "EdgeAwareGNN")
    assert (row["validation_best_mse"], row["validation_best_epoch"], row["test_access_before_freeze"], row["seed"]) == (of["best_val_mse"], of["best_epoch"], False, 3)
    assert selection.freeze(spark, ledger, path, "EdgeAwareGNN", seed=3).first() == row  # again: the same
    with pytest.raises(ValueError, match="another selection"):
        selection.freeze(spark, ledger, path, "MLP", seed=3)
    with pytest.raises(ValueError, match="no validated epoch"):
        selection.freeze(spark, ledger, str(tmp_path / "other"), "absent")


def test_tests_wait_for_a_selection_and_cover_every_graph(spark, fixture, tmp_path):
    nodes, edges, ledger = fixture
    path = str(tmp_path / "frozen")
    with pytest.raises(ValueError, match="before the test"):
        selection.tested(ledger, path, NET, nodes, edges, ["u", "v"])
    selection.freeze(spark, ledger, path, "EdgeAwareGNN")
    overall, each = selection.tested(ledger, path, NET, nodes, edges, ["u", "v"], inverse=lambda k, c: c * (k + 1), batches=2)
    got = {(r["model"], r["target"]): r for r in overall.collect()}
    assert got.keys() == {(m, t) for m in NET for t in "uv"} and all(r["n"] == 8 and r["mean_inference_ms_per_graph"] > 0 for r in got.values())
    assert all(r["selected"] == (m == "EdgeAwareGNN") for (m, _), r in got.items())
    p = {(r["sample_id"], r["node"]): r["p"] for r in training.predict(NET["MLP"], training.best_weights(spark, ledger, "MLP"), nodes).collect()}
    y = {(r["sample_id"], r["node"]): r["y"] for r in nodes.collect()}
    for k, target in enumerate("uv"):
        d = [(k + 1) * (p[key][k] - y[key][k]) for key in y]
        assert got["MLP", target]["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(d))))
    assert {(r["model"], r["sample_id"], r["target"]) for r in each.collect()} == {(m, s, t) for m in NET for s in "cd" for t in "uv"}
