"""Joins with declared cardinality, counts over fixed domains, set gates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.ordering import positioned


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails, when it runs, if a key repeats on either side."""
    unique = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.lit(f"keys {keys} repeat")).cast("bigint")))
    checked = unique(left).join(unique(right).withColumnRenamed("_n", "_m"), keys, "left").filter((F.col("_n") == 1) & (F.coalesce("_m", F.lit(1)) == 1))
    return checked.drop("_n", "_m")


def crosstab(df: DataFrame, a: str, b: str, domain: list) -> DataFrame:
    """Counts of b's values for each a, absent ones 0."""
    counts = df.groupBy(a).pivot(b, domain).agg(F.count(F.lit(1)))
    return counts.select(a, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(str(v)) for v in domain])


def aligned_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts by key on both sides, absent ones 0."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return n(left, "n_left").join(n(right, "n_right"), key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).cast("bigint").alias("n_left"), F.coalesce("n_right", F.lit(0)).cast("bigint").alias("n_right"))


def attrition(original: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows there were, are and went, and the share that stayed, by group."""
    was = original.groupBy(*keys).agg(F.count(F.lit(1)).alias("original_n"))
    now = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_n"))
    df = was.join(now, keys, "left").withColumn("kept_n", F.coalesce("kept_n", F.lit(0)).cast("bigint"))
    return df.withColumn("excluded_n", F.col("original_n") - F.col("kept_n")).withColumn("retention_pct", 100 * F.col("kept_n") / F.col("original_n"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order that breaks every tie."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def low_mid_high(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First, middle (n div 2) and last row of each group; all rows of groups below three."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return df.filter("_r in (0, _n div 2, _n - 1)").withColumn("position", F.expr("case when _r = 0 then 'low' when _r = _n - 1 then 'high' else 'mid' end")).drop("_r", "_n")


def dedup_edges(edges: DataFrame, *tie: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """Undirected edges once, the shortest of each; self-loops go. Ends are stored in order."""
    e = edges.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")}).filter("source <> target")
    return first_by(e, [*group, "source", "target"], F.col("path_length"), *tie)


def reindexed(df: DataFrame, key: str, name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Dense numbers from 0 in key order, in each group or over all rows."""
    if group:
        return df.withColumn(name, (F.dense_rank().over(Window.partitionBy(*group).orderBy(key)) - 1).cast("bigint"))
    return df.join(positioned(df.select(key).distinct(), [], [F.col(key)], name), key)


def stratified_split(df: DataFrame, group: str, order: list[Column], train: float, validation: float) -> DataFrame:
    """Shares of each group, in the given order: train, validation, test."""
    df = positioned(df, [group], order, "_r", "_n")
    split = F.when(F.col("_r") < F.floor(F.col("_n") * train), "train").when(F.col("_r") < F.floor(F.col("_n") * (train + validation)), "validation").otherwise("test")
    return df.withColumn("split", split).drop("_r", "_n")


def leave_one_out(df: DataFrame, group: str, values: list[str], order: list[Column], validation: float) -> DataFrame:
    """A column for each value: its rows test, of the others the first share validation, the rest train."""
    for v in values:
        df = positioned(df.withColumn("_rest", F.col(group) != v), ["_rest"], order, "_r", "_n")
        df = df.withColumn(f"leave_{v}", F.when(~F.col("_rest"), "test").when(F.col("_r") < F.floor(F.col("_n") * validation), "validation").otherwise("train")).drop("_r", "_n", "_rest")
    return df


def latin_hypercube(rows: DataFrame, n: int, dims: list[str], seed: int = 42) -> DataFrame:
    """Points of the unit cube, one in each of n strata of every dimension; ``rows`` has a column i of 0 to n - 1."""
    for k, d in enumerate(dims):
        h = F.xxhash64(F.lit(seed), F.lit(k), "i")
        u = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(k), "i"), F.lit(1 << 30)) / (1 << 30)
        rows = positioned(rows, [], [h, F.col("i")], "_r").withColumn(d, (F.col("_r") + u) / n).drop("_r")
    return rows


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A random sample of n rows (all, if there are fewer): those whose keys hash lowest, the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def set_gate(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: keys missing on either side, and whether the sets are equal."""
    a, b = left.distinct(), right.distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    df = n(a.exceptAll(b), "missing_right").crossJoin(n(b.exceptAll(a), "missing_left"))
    return df.withColumn("equal", (F.col("missing_right") == 0) & (F.col("missing_left") == 0))


def shards(df: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Consecutive shards of ``size`` rows in each group, and the position (from 1) in a shard."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("_r", r).withColumns({"shard": F.floor(F.col("_r") / size).cast("bigint"), "position": (F.col("_r") % size + 1).cast("bigint")}).drop("_r")


def running_best(df: DataFrame, keys: list[str], epoch: str, value: str, min_delta: float, patience: int) -> DataFrame:
    """Early stopping over each group's epochs: best epoch and value, and where patience ran out (else the last).

    The best moves only if it falls by more than ``min_delta``: a fold over the ordered epochs of one group.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("best_epoch"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        better = acc["best"].isNull() | (x["v"] < acc["best"] - min_delta)
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        moved = F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(better, x["e"]).otherwise(acc["best_epoch"]).alias("best_epoch"), bad.alias("bad"), F.when(bad >= patience, x["e"]).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("e"), F.col(value).cast("double").alias("v")))).alias("x"))
    out = rows.withColumn("f", F.aggregate("x", start, step))
    return out.select(*keys, F.col("f.best_epoch").alias("best_epoch"), F.col("f.best").alias("best"), F.coalesce(F.col("f.stop"), F.element_at("x", -1)["e"]).alias("stop_epoch"))


def plateau(df: DataFrame, keys: list[str], epoch: str, value: str, rate: float, factor: float = 0.5, patience: int = 10, least: float = 1e-5, threshold: float = 1e-4) -> DataFrame:
    """keys, epoch and the learning rate after it: cut by ``factor`` where more than ``patience`` epochs in a row bring no relative gain of ``threshold``.

    A fold over the ordered epochs of one group.
    """
    none = F.array().cast("array<struct<e: bigint, rate: double>>")
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(float(rate)).alias("rate"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        better = x["v"] < acc["best"] * (1 - threshold)
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        cut = bad > patience
        new = F.when(cut, F.greatest(acc["rate"] * factor, F.lit(float(least)))).otherwise(acc["rate"])
        return F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(cut, F.lit(0)).otherwise(bad).alias("bad"), new.alias("rate"), F.array_append(acc["out"], F.struct(x["e"].alias("e"), new.alias("rate"))).alias("out"))

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("e"), F.col(value).cast("double").alias("v")))).alias("x"))
    return rows.select(*keys, F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("o")).select(*keys, F.col("o.e").alias(epoch), F.col("o.rate").alias("rate"))


def cover_gate(assigned: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: keys assigned more than once, not at all, or not wanted, and whether the assignment covers exactly."""
    n = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(wanted.select(key).distinct().withColumn("w", F.lit(1)), key, "full_outer")
    out = n.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("unwanted"))
    return out.withColumn("exact", (F.col("repeated") == 0) & (F.col("missing") == 0) & (F.col("unwanted") == 0))
