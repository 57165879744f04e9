"""Spectra of small and large components against dense matrices."""

import numpy as np
import pytest

from meshwright.operators import spectra

EDGES = "sample_id string, source bigint, target bigint"


def plain(edges, k):
    """The definition, on a sample's whole matrix: all eigenvalues but one zero for each component."""
    out = {}
    for sample in {s for s, *_ in edges}:
        own = [(s, t) for x, s, t in edges if x == sample]
        ids = sorted({v for e in own for v in e})
        a = np.zeros((len(ids), len(ids)))
        for s, t in own:
            a[ids.index(s), ids.index(t)] = a[ids.index(t), ids.index(s)] = 1
        d = 1 / np.sqrt(a.sum(0))
        values = np.linalg.eigvalsh(np.eye(len(ids)) - d[:, None] * a * d)
        out[sample] = [v for v in values if v > 1e-9][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("sample_id", "rank").collect():
        out.setdefault(r["sample_id"], []).append(r["value"])
    return out


def communities(sample, n, of, seed):
    """A ring of n nodes with chords, most of them inside groups of ``of``."""
    rng = np.random.default_rng(seed)
    edges = {(i, (i + 1) % n) for i in range(n)}
    while len(edges) < 3 * n:
        a, b = (int(x) for x in rng.integers(0, n, 2))
        if a // of == b // of or rng.random() < 0.05:
            edges.add((a, b))
    return [(sample, a, b) for a, b in sorted(edges)]


def test_known_spectra(spark):
    rows = [("t", 0, 1), ("t", 1, 2), ("t", 0, 2), ("two", 0, 1), ("two", 5, 6), ("two", 6, 7), ("loop", 3, 3), ("twice", 1, 2), ("twice", 2, 1), ("twice", 1, 2)]
    got = found(spectra.spectral_signature(spark.createDataFrame([*rows, ("t", None, 1)], EDGES)))
    assert got["t"] == pytest.approx([1.5, 1.5])
    assert got["two"] == pytest.approx([1, 2, 2])
    assert got["twice"] == pytest.approx([2])
    assert "loop" not in got
    assert spectra.spectral_signature(spark.createDataFrame([], EDGES)).count() == 0


def test_iterated_components_equal_dense_matrices(spark):
    """Two large components of one sample with equal eigenvalues, another sample, and small ones beside them."""
    one = communities("a", 120, 40, 1)
    rows = one + [(s, a + 1000, b + 1000) for s, a, b in one] + [("a", 5000, 5001), ("a", 5001, 5002)] + communities("b", 150, 30, 2) + [("c", 0, 1)]
    df = spectra.spectral_signature(spark.createDataFrame(rows, EDGES), k=4, dense=0, tile=32).cache()
    got, want = found(df), plain(rows, 4)
    assert got.keys() == want.keys()
    for sample in want:
        assert got[sample] == pytest.approx(want[sample], abs=1e-6)
    assert df.filter("bound > 1e-5").count() == 0


def test_steps_that_are_used_up_leave_a_bound(spark):
    rows = communities("a", 120, 40, 1)
    got = spectra.spectral_signature(spark.createDataFrame(rows, EDGES), k=4, dense=0, tile=64, steps=2).collect()
    every = plain(rows, 200)["a"]
    assert len(got) == 4
    assert all(r["bound"] > 1e-5 and min(abs(r["value"] - v) for v in every) <= r["bound"] + 1e-9 for r in got)


def test_repeated_values_and_short_bases():
    """Ritz values of a basis with a repeated, a zero and a dependent column."""
    rng = np.random.default_rng(3)
    m = np.diag([1.0, 0.9, 0.9, 0.5, 0.1, 0.0])
    z = np.eye(6)[:, :1]
    s = rng.normal(size=(6, 6))
    s[:, 1], s[:, 2] = s[:, 0], 0
    basis = np.hstack([z, s])
    c = spectra.ritz(basis.T @ basis, basis.T @ m @ basis, 2)
    x = basis @ c[:-1, :2]
    assert c[-1, :2] == pytest.approx(np.diag(x.T @ m @ x), abs=1e-9)
    assert x.T @ x == pytest.approx(np.eye(2), abs=1e-9)
    assert np.abs(x.T @ z).max() < 1e-9


def ring(sample, n):
    """Each of n nodes in a ring has links to the next and the third."""
    return [(sample, i, (i + d) % n) for i in range(n) for d in (1, 3)]


def test_long_rings_have_their_known_values(spark):
    """Eigenvalues of some 10^-5 lie close together: inverse iteration separates them, in two components of a sample too."""
    n = 3000
    rows = ring("a", n) + [("b", s + o, t + o) for o in (0, 5000) for _, s, t in ring("b", n)] + communities("c", 500, 50, 4)
    df = spectra.spectral_signature(spark.createDataFrame(rows, EDGES), k=4, dense=0, tile=300).cache()
    got, angle = found(df), 2 * np.pi * np.arange(1, n // 2) / n
    want = np.sort(np.repeat(1 - (np.cos(angle) + np.cos(3 * angle)) / 2, 2))
    assert got["a"] == pytest.approx(want[:4], rel=1e-4)
    assert got["b"] == pytest.approx(np.sort(np.repeat(want, 2))[:4], rel=1e-4)
    assert got["c"] == pytest.approx(plain(communities("c", 500, 50, 4), 4)["c"], abs=1e-6)
    assert df.filter("bound > 1e-3 * value").count() == 0


def test_components_of_wide_borders_iterate(spark):
    rows = communities("a", 120, 40, 1) + communities("b", 150, 30, 2)
    df = spectra.spectral_signature(spark.createDataFrame(rows, EDGES), k=4, dense=0, tile=32, core=8).cache()
    got, want = found(df), plain(rows, 4)
    for sample in want:
        assert got[sample] == pytest.approx(want[sample], abs=1e-6)
    assert df.filter("bound > 1e-5").count() == 0
