"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: columns ``node`` and ``root`` (smallest node reachable).

    Alternating large-star and small-star steps (Kiveris et al., 2014): the rounds grow with the logarithm
    of the longest path, the rows never exceed the edges plus the nodes, and each round is written to the
    shared folder, so lineage stays short. Self-loops count as a node without links; null ends are ignored.
    """
    node = edges.schema[a].dataType
    e = edges.select(F.col(a).cast(node).alias("u"), F.col(b).cast(node).alias("v")).filter("u is not null and v is not null")
    loops = e.filter("u = v").select(F.col("u").alias("node"))
    e = written(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")
        )
        e = written(small.select("p.*").filter("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = root.select(F.col("root").alias("node")).union(loops).distinct()
    return root.unionByName(own.join(root, "node", "left_anti").select("node", F.col("node").alias("root")))
