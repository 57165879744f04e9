"""Declarative constraints, status of checkpoints, failure categories and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of the failure categories, in the order in which they are tried (fixed values).
FAILURES = (
    ("mapping_qc", ("mapping", "k32", "radius")),
    ("geometry_qc", ("geometry", "component", "rho_err")),
    ("mesh_qc_or_meshing", ("mesh", "tetgen")),
    ("solver", ("ccx", "calculix", "solver")),
    ("parser_or_field_output", ("parse", "stress", "strain")),
)


def issues(rules: dict[str, Column]) -> Column:
    """The messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(m)) for m, p in rules.items()]))


def status(success: Column, failure: Column, problems: Column, readable: Column, elsewhere: Column) -> Column:
    """The state of a checkpoint from its markers, its issues, and whether another worker has it too."""
    none = F.size(problems) == 0
    return (
        F.when(~success & ~failure, "MISSING_OR_IN_PROGRESS")
        .when(success & failure, "INVALID_CONFLICT")
        .when(success & none & elsewhere, "INVALID_CROSS_WORKER_DUPLICATE")
        .when(success & none, "VERIFIED")
        .when(success, "INVALID_SUCCESS_CHECKPOINT")
        .when(readable, "TERMINAL_QC_FAILURE")
        .otherwise("INVALID_FAILURE_RECORD")
    )


def failure_category(*texts: Column) -> Column:
    """The first category that has a keyword in the texts."""
    t = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(None).cast("string")
    for name, keys in reversed(FAILURES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | t.contains(k)
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def gates(df: DataFrame, **aggregates: Column) -> DataFrame:
    """(gate, pass) rows, one for each boolean aggregate over ``df``; NULL fails."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in aggregates.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("pass")) for k in aggregates])).alias("x")).select("x.gate", "x.pass")


def require(df: DataFrame, name: str = "constraint") -> None:
    """Raise if the table of violations has a row; the message shows up to five."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{name}: {[r.asDict() for r in rows]}")


def identity_mismatch(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose other columns differ between two tables, or that one of them lacks."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    m = left.withColumn("_l", F.lit(1)).alias("l").join(right.withColumn("_r", F.lit(1)).alias("r"), on, "full_outer")
    reason = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(~same, "differs")
    return m.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], reason.alias("reason")).filter("reason is not null")
