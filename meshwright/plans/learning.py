"""Whole graph networks and their training as queries; SQL of the forward passes is made from the same weights, layer by layer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import graphs, selection, training
from meshwright.plans import catalog
from meshwright.plans.registry import query, rounded
from meshwright.shared import new_path, written


def _graph(t) -> tuple[DataFrame, DataFrame]:
    """Nodes with x (their place, and two means of their sample) and y; edges both ways with two features."""
    nodes, edges = catalog._vector_graph(t)
    vector = nodes.groupBy("sample_id").agg(F.avg("x").alias("g0"), F.avg("y").alias("g1"))
    n = nodes.join(vector, "sample_id").select("sample_id", "node", F.array("x", "y", "z", "g0", "g1").alias("x"), F.array(F.col("x") - F.col("y"), F.col("z") * 2).alias("y"))
    return n, graphs.doubled(edges).dropDuplicates(["sample_id", "source", "target"]).select("sample_id", "source", "target", F.array("path_length", 1 - F.col("path_length")).alias("attr"))


_INPUT = f"""{catalog._VG}, gv as (select label, avg(e0) as g0, avg(e1) as g1 from v group by 1), x0 as (select v.label, vec_id as node, e0 as x0, e1 as x1, e2 as x2, g0 as x3, g1 as x4 from v join gv on gv.label = v.label),
a0 as (select label, source, target, w::double as a0, 1 - w::double as a1 from e union all select label, target, source, w::double, 1 - w::double from e)"""


class _Sql:
    """The tables of a forward pass; each layer is a select that adds columns."""

    def __init__(self, weights: training.Weights):
        self.weights, self.tables = weights, []

    def add(self, body: str) -> str:
        self.tables.append(f"s{len(self.tables)} as ({body})")
        return f"s{len(self.tables) - 1}"

    def columns(self, table: str, exprs: list[str]) -> tuple[str, list[str]]:
        names = [f"c{len(self.tables)}_{j}" for j in range(len(exprs))]
        return self.add("select *, " + ", ".join(f"{e} as {n}" for e, n in zip(exprs, names, strict=True)) + f" from {table}"), names

    def dense(self, table: str, cols: list[str], name: str, relu: bool, plus: str | None = None, more: list[str] | None = None) -> tuple[str, list[str]]:
        def sums(cols: list[str], name: str) -> list[str]:
            w, b = self.weights[f"{name}.w"], self.weights[f"{name}.b"]
            return [f"({b[j]!r}" + "".join(f" + ({w[i][j]!r})::double * {c}" for i, c in enumerate(cols)) + ")" for j in range(len(b))]

        each = sums(cols, name)
        if plus:
            each = [f"({p} + {q})" for p, q in zip(each, sums(more, plus), strict=True)]
        return self.columns(table, [f"greatest(0::double, {x})" if relu else x for x in each])

    def chain(self, table: str, cols: list[str], name: str, n: int, last: bool = False) -> tuple[str, list[str]]:
        for k in range(n):
            table, cols = self.dense(table, cols, f"{name}.{k}", last or k + 1 < n)
        return table, cols

    def norm(self, table: str, cols: list[str], name: str) -> tuple[str, list[str]]:
        mean = f"(({' + '.join(cols)}) / {len(cols)})"
        var = "((" + " + ".join(f"({c} - {mean}) ** 2" for c in cols) + f") / {len(cols)})"
        g, s = self.weights[f"{name}.g"], self.weights[f"{name}.s"]
        return self.columns(table, [f"(({c} - {mean}) / sqrt({var} + 1e-5) * ({g[j]!r})::double + ({s[j]!r})::double)" for j, c in enumerate(cols)])

    def sums(self, table: str, a: list[str], b: list[str]) -> tuple[str, list[str]]:
        return self.columns(table, [f"({p} + {q})" for p, q in zip(a, b, strict=True)])


def _forward_sql(network: training.Network, weights: training.Weights) -> str:
    q, kind = _Sql({k: v.tolist() for k, v in weights.items()}), network.kind
    name = lambda p, cols: ", ".join(f"{c} as {p}{j}" for j, c in enumerate(cols))
    of = lambda p, cols: [f"{p}{j}" for j in range(len(cols))]
    t, h = q.chain("x0", [f"x{k}" for k in range(5)], "in", {"mlp": 3, "sage": 1, "edge": 2, "sum": 2}[kind], kind != "edge")
    e, a = "a0", ["a0", "a1"]
    if kind == "sum":
        t, h = q.norm(t, h, "in.norm")
        e, a = q.norm(*q.chain(e, a, "edges", 2, True), "edges.norm")
    for k in range(network.rounds):
        t, e = q.add(f"select label, node, {name('h', h)} from {t}"), q.add(f"select label, source, target, {name('a', a)} from {e}")
        h, a = of("h", h), of("a", a)
        g = q.add(f"select e.*, {name('hs', [f's.{c}' for c in h])}, {name('ht', [f't.{c}' for c in h])} from {e} e join {t} s on s.label = e.label and s.node = e.source join {t} t on t.label = e.label and t.node = e.target")
        hs, ht = of("hs", h), of("ht", h)
        if kind == "sage":
            m = hs
        elif kind == "edge":
            g, m = q.chain(g, [*ht, *hs, *a], f"message{k}", 2, True)
        else:
            g, m = q.norm(*q.chain(g, [*ht, *hs, *a], "message", 2, True), "message.norm")
            g, new = q.norm(*q.chain(g, [*hs, *ht, *a], "message", 2, True), "message.norm")
            e, a = q.sums(g, a, new)
        how = "sum" if kind == "sum" else "avg"
        got = q.add(f"select label, target, {', '.join(f'{how}({c}) as m{j}' for j, c in enumerate(m))} from {g} group by 1, 2")
        t = q.add(f"select n.*, {', '.join(f'coalesce({c}, 0) as {c}' for c in of('m', m))} from {t} n left join {got} r on r.label = n.label and r.target = n.node")
        m = of("m", m)
        if kind == "sage":
            t, u = q.dense(t, m, f"near{k}", True, f"own{k}", h)
            t, h = q.norm(*q.sums(t, h, u), f"norm{k}")
        elif kind == "edge":
            t, u = q.chain(t, [*h, *m], f"update{k}", 2)
            t, h = q.norm(*q.sums(t, h, u), f"norm{k}")
        else:
            t, u = q.norm(*q.chain(t, [*m, *h], "update", 2, True), "update.norm")
            t, h = q.sums(t, h, u)
    t, p = q.chain(t, h, "head", {"mlp": 1, "sage": 2, "edge": 3, "sum": 2}[kind])
    return f"{_INPUT}, {', '.join(q.tables)} select label::varchar as sample_id, node, round({p[0]}, 6) as p0, round({p[1]}, 6) as p1 from {t}"


def _fixed(network: training.Network) -> training.Weights:
    return {k: np.round(v, 3) for k, v in network.weights(7).items()}


_MLP, _SAGE, _EDGE, _SUM = (training.Network(kind, 5, 2, 4, steps) for kind, steps in (("mlp", 0), ("sage", 4), ("edge", 2), ("sum", 3)))


def _outputs(t, network: training.Network) -> DataFrame:
    nodes, edges = _graph(t)
    p = training.predict(network, _fixed(network), nodes, edges)
    return rounded(p.select("sample_id", "node", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")))


@query(_forward_sql(_MLP, _fixed(_MLP)))
def gnn_mlp_network(t):
    return _outputs(t, _MLP)


@query(_forward_sql(_SAGE, _fixed(_SAGE)))
def gnn_sage_network(t):
    return _outputs(t, _SAGE)


@query(_forward_sql(_EDGE, _fixed(_EDGE)))
def gnn_edge_network(t):
    return _outputs(t, _EDGE)


@query(_forward_sql(_SUM, _fixed(_SUM)))
def gnn_sum_network(t):
    return _outputs(t, _SUM)


@query()
def gnn_training(t):
    """Two epochs of an edge network; samples of odd labels validate."""
    nodes, edges = (written(df, "learning") for df in _graph(t))
    odd = F.col("sample_id").cast("int") % 2 == 1
    return training.train(training.Network("edge", 5, 2, 4, 1), training.Protocol(rate=0.02, epochs=2), nodes.filter(~odd), nodes.filter(odd), edges, new_path(nodes.sparkSession, "ledger"))


@query()
def gnn_selection(t):
    """A network and the plain perceptron, trained on a third of the samples and validated on another; the network is frozen, then both are tested."""
    nodes, edges = (written(df, "learning") for df in _graph(t))
    third = F.col("sample_id").cast("int") % 3
    spark, ledger, path = nodes.sparkSession, new_path(nodes.sparkSession, "ledger"), new_path(nodes.sparkSession, "frozen")
    networks = {"EdgeAwareGNN": training.Network("edge", 5, 2, 8, 1), "MLP": training.Network("mlp", 5, 2, 8)}
    for run, network in networks.items():
        training.train(network, training.Protocol(rate=0.02, epochs=1), nodes.filter(third == 0), nodes.filter(third == 1), edges, ledger, run)
    selection.freeze(spark, ledger, path, "EdgeAwareGNN")
    overall, _ = selection.tested(ledger, path, networks, nodes.filter(third == 2), edges, ["u", "v"], batches=2)
    return rounded(overall.drop("mean_inference_ms_per_graph", "median_inference_ms_per_graph"))
