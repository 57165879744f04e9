"""Forward passes of graph networks over node and edge tables: states are arrays, messages are joins and grouped means.

Weights are plain lists: a dense layer is (weights, bias), weights[i][j] from input i to output j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Dense = tuple[list[list[float]], list[float]]


def dense(x: Column, layer: Dense) -> Column:
    """A dense layer over an array column."""
    weights, bias = layer
    row = lambda j: F.array(*[F.lit(float(w[j])) for w in weights])
    return F.array(*[F.aggregate(F.zip_with(x, row(j), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for j, b in enumerate(bias)])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def perceptron(df: DataFrame, x: Column, layers: list[Dense], name: str, last: bool = False) -> DataFrame:
    """``df`` with ``name``: dense layers with rectifiers between them (and after the last, if asked)."""
    df = df.withColumn(name, x)
    for k, layer in enumerate(layers):
        y = dense(F.col(name), layer)
        df = df.withColumn(name, relu(y) if last or k + 1 < len(layers) else y)
    return df


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    """Each array less its mean, over its population standard deviation."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + epsilon))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def gathered(messages: DataFrame, width: int, how: str = "mean") -> DataFrame:
    """(sample_id, node, m): the mean or sum of the messages m to each target, element by element."""
    agg = F.avg if how == "mean" else F.sum
    return messages.groupBy("sample_id", F.col("target").alias("node")).agg(F.array(*[agg(F.get("m", F.lit(i))) for i in range(width)]).alias("m"))


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed edges with the states of both ends: source as hs, target as ht."""
    e = edges.join(nodes.select("sample_id", F.col("node").alias("source"), F.col("h").alias("hs")), ["sample_id", "source"])
    return e.join(nodes.select("sample_id", F.col("node").alias("target"), F.col("h").alias("ht")), ["sample_id", "target"])


def _received(nodes: DataFrame, messages: DataFrame, width: int, how: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), width)
    return nodes.join(gathered(messages, width, how), ["sample_id", "node"], "left").withColumn("m", F.coalesce("m", zero))


def sage_layer(nodes: DataFrame, edges: DataFrame, neighbours: Dense, own: Dense) -> DataFrame:
    """Neighbours' mean and own state through dense layers, rectified, added to the state, and normalised."""
    at = edges.join(nodes.select("sample_id", F.col("node").alias("source"), F.col("h").alias("m")), ["sample_id", "source"])
    n = _received(nodes, at, len(neighbours[0]), "mean").withColumn("new", relu(plus(dense(F.col("m"), neighbours), dense(F.col("h"), own))))
    return n.withColumn("h", layer_norm(plus(F.col("h"), F.col("new")))).select("sample_id", "node", "h")


def edge_message_layer(nodes: DataFrame, edges: DataFrame, message: list[Dense], update: list[Dense]) -> DataFrame:
    """Messages of target, source and edge (edges have ``attr``), averaged at targets; a residual update, normalised."""
    m = perceptron(_ends(nodes, edges), F.concat("ht", "hs", "attr"), message, "m", last=True)
    n = perceptron(_received(nodes, m, len(message[-1][1]), "mean"), F.concat("h", "m"), update, "u")
    return n.select("sample_id", "node", layer_norm(plus(F.col("h"), F.col("u"))).alias("h"))


def sum_block(nodes: DataFrame, edges: DataFrame, edge: list[Dense], node: list[Dense]) -> tuple[DataFrame, DataFrame]:
    """One step of sums: messages of target, source and edge state are added up at targets; both states have residual updates.

    Every perceptron ends in a rectifier and a normalisation. The edge's own update reads its source first.
    """
    both = perceptron(_ends(nodes, edges), F.concat("ht", "hs", "attr"), edge, "m", last=True).withColumn("m", layer_norm(F.col("m")))
    n = perceptron(_received(nodes, both, len(edge[-1][1]), "sum"), F.concat("m", "h"), node, "u", last=True)
    e = perceptron(both, F.concat("hs", "ht", "attr"), edge, "new", last=True)
    return n.select("sample_id", "node", plus(F.col("h"), layer_norm(F.col("u"))).alias("h")), e.select("sample_id", "source", "target", plus(F.col("attr"), layer_norm(F.col("new"))).alias("attr"))
