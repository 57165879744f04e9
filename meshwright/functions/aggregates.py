"""Aggregates of the field data: all have partial forms, so they combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.scalars import nan_to_null
from meshwright.operators.ordering import quantiles


def metric_bundle(y: Column, p: Column) -> dict[str, Column]:
    """RMSE, MAE, RMSE over the range, R2 and Pearson's r; NULL where a denominator vanishes."""
    e = p - y
    rmse = F.sqrt(F.avg(e * e))
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return {
        "n": F.count(F.lit(1)),
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "nrmse_range": F.try_divide(rmse, F.max(y) - F.min(y)),
        "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1))),
        "pearson_r": F.try_divide(F.covar_pop(y, p), spread),
    }


def metrics_by(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in metric_bundle(F.col(y), F.col(p)).items()])


def wide_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, median and max of each column, NaN skipped as NULL is; exact, whatever a group's size."""
    aggs, medians = [], []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}_count"), F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
        medians.append(F.max(F.when(F.col("name") == c, F.get("q", F.lit(0)))).alias(f"{c}_median"))
    one = df.groupBy(*keys).agg(*aggs)
    two = quantiles(df, keys, columns, (0.5,)).groupBy(*keys).agg(*medians)
    same = F.lit(True)
    for k in keys:
        same = same & one[k].eqNullSafe(two[k])
    return one.join(two, same, "left").select(*[one[c] for c in one.columns], *[two[f"{c}_median"] for c in columns])


def weighted_mean(x: Column, w: Column) -> Column:
    """Weights below 1 count as 1."""
    w = F.greatest(w, F.lit(1.0))
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def mean_std(df: DataFrame, columns: list[str], fixed: tuple[str, ...] = (), floor: float = 1e-12) -> DataFrame:
    """One row: mean and population std of each column; a std below ``floor`` is 1, ``fixed`` columns have 0 and 1."""
    aggs = []
    for c in columns:
        if c in fixed:
            aggs += [F.lit(0.0).alias(f"{c}_mean"), F.lit(1.0).alias(f"{c}_std")]
        else:
            s = F.stddev_pop(c)
            aggs += [F.avg(c).alias(f"{c}_mean"), F.when(s < floor, 1.0).otherwise(s).alias(f"{c}_std")]
    return df.agg(F.count(F.lit(1)).alias("n_fit"), *aggs)


def all_true(p: Column) -> Column:
    """NULL counts as false."""
    return F.bool_and(F.coalesce(p, F.lit(False)))


def fraction(p: Column) -> Column:
    return F.avg(F.coalesce(p, F.lit(False)).cast("double"))


def losses(y: Column, p: Column) -> dict[str, Column]:
    """Mean squared and mean absolute error over all elements."""
    return {"numel": F.count(F.lit(1)), "mse": F.sum((p - y) * (p - y)) / F.greatest(F.count(F.lit(1)), F.lit(1)), "l1": F.sum(F.abs(p - y)) / F.greatest(F.count(F.lit(1)), F.lit(1))}


def vector_sum(*columns: str) -> list[Column]:
    """The sum of vectors, component by component."""
    return [F.sum(c).alias(c) for c in columns]


def per_dimension(x: Column, width: int) -> list[Column]:
    """Mean and population std of each element of an array column."""
    return [f(F.get(x, F.lit(i))).alias(f"{n}_{i}") for i in range(width) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
