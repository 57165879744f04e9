"""Positions and quantiles of ordered groups of any size: no group is held or sorted by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.shared import written


def _ranges(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` and _range: pieces of each group, ascending in the given order. Written, as boundaries are sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), name)


def _before(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """For each group and range, the sum of ``size`` in the ranges before it, and in all: a row for each range."""
    w = Window.partitionBy(*keys).orderBy("_range")
    sizes = rows.groupBy(*keys, "_range").agg(size.alias("_size"))
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_size").over(whole)}).drop("_size")


def _beside(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in (*keys, "_range"):
        same = same & rows[k].eqNullSafe(totals[k])
    return rows.join(totals, same).select(*[rows[c] for c in rows.columns], totals["_before"], totals["_all"])


def positioned(df: DataFrame, keys: list[str], order: list[Column], position: str = "position", size: str | None = None) -> DataFrame:
    """``df`` with each row's number (from 0) in its group, in an order that breaks every tie, and the group's size."""
    rows = _ranges(df, keys, order, "positions")
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    out = _beside(own, _before(rows, keys, F.count(F.lit(1))), keys)
    out = out.withColumn(position, (F.col("_own") + F.col("_before")).cast("bigint"))
    out = out.withColumn(size, F.col("_all")) if size else out
    return out.drop("_own", "_range", "_before", "_all")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], at: tuple[float | Column, ...]) -> DataFrame:
    """keys, name (of the column) and q: exact quantiles with linear interpolation; NULL and NaN are skipped.

    ``at``: shares, or columns among the keys. Values are counted first, so repeated ones travel once. A quantile is made of the one or two values whose
    ranks enclose it.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    values = long.select(*keys, "x.name", "x.v").filter("v is not null and not isnan(v)").groupBy(*keys, "name", "v").agg(F.count(F.lit(1)).alias("n"))
    by = [*keys, "name"]
    rows = _ranges(values, by, [F.col("v")], "quantiles")
    to = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    out = _beside(rows.withColumn("_to", to), _before(rows, by, F.sum("n")), by)
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((q if isinstance(q, Column) else F.lit(float(q))) * (F.col("_all") - 1)).alias("p")) for i, q in enumerate(at)]))
    out = out.select(*by, "v", (F.col("_before") + F.col("_to") - F.col("n")).alias("a"), (F.col("_before") + F.col("_to") - 1).alias("b"), place.alias("x")).select(*by, "v", "a", "b", "x.i", "x.p")
    # ranks a to b hold v; of the values around a place, each counts by its nearness
    low, high = F.floor("p"), F.ceil("p")
    share = F.when((F.col("a") <= low) & (high <= F.col("b")), 1.0).when((F.col("a") <= low) & (low <= F.col("b")), high - F.col("p")).when((F.col("a") <= high) & (high <= F.col("b")), F.col("p") - low)
    out = out.withColumn("share", share).filter("share is not null").groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("share")).alias("q"))
    return out.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
