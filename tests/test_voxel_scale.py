"""Grids, masks and surfaces at scale: what joins, and how, whatever Spark takes their sizes for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import geometry


def fields(spark, samples=4, size=300):
    """Fields of each sample with ties, a NULL and a NaN; a table so small by Spark's estimate that it would be broadcast."""
    k = F.col("id") % size
    f = F.when(k == 7, None).when(k == 8, float("nan")).otherwise(F.sin(F.floor(k / 3) * (F.floor(F.col("id") / size) + 1)) * 2)
    rows = spark.range(samples * size).select(F.floor(F.col("id") / size).cast("string").alias("sample_id"), k.alias("id"), f.alias("f"), F.lit(0.8).alias("profile"))
    return rows.withColumn("target_relative_density", 0.2 + F.col("sample_id").cast("double") / 5)


@pytest.mark.parametrize("most", [0, 500_000])
def test_thresholds_are_exact_and_fields_are_never_broadcast(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(geometry, "BROADCAST_ROWS", most)
    df = fields(spark)
    got = {r["sample_id"]: r["tau"] for r in geometry.calibrated(df).collect()}
    for s, rows in df.toPandas().groupby("sample_id"):
        v = (rows["f"].abs() / rows["profile"]).dropna()
        assert got[s] == pytest.approx(np.quantile(v, rows["target_relative_density"].iloc[0]), abs=1e-12), s
    m = geometry.masked(df)
    m.select("sample_id", "id", "solid").explain()
    plan = capsys.readouterr().out
    # what is broadcast, if anything, is the table of thresholds
    assert ("BuildLeft" not in plan) and ("BroadcastHashJoin" in plan) == (most > 0) and ("SortMergeJoin" in plan) == (most == 0)
    assert m.filter("solid").count() == sum((np.abs(r["f"]) / r["profile"] <= got[s] + 1e-9).sum() for s, r in df.toPandas().groupby("sample_id"))


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_voxel_joins_are_merged(spark, capsys):
    v = spark.range(64).select(F.lit("s").alias("sample_id"), "id", F.floor(F.col("id") / 16).alias("i"), (F.floor(F.col("id") / 4) % 4).alias("j"), (F.col("id") % 4).alias("k"))
    for df in (geometry.adjacent(v), geometry.voxel_surface(v)):
        plan = plan_of(df, capsys)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    axes = {r["axes"]: r["count"] for r in geometry.adjacent(v, 26, "axes").groupBy("axes").count().collect()}
    assert axes == {1: 3 * 4 * 4 * 3, 2: 3 * 2 * 3 * 3 * 4, 3: 4 * 27}


def test_surface_measures_broadcast_nothing(spark, capsys):
    faces = spark.createDataFrame([("s", 0, 2, 1), ("s", 0, 1, 3), ("s", 1, 2, 3), ("s", 2, 0, 3)], "sample_id string, a bigint, b bigint, c bigint")
    points = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 1.0, 0.0, 0.0), ("s", 2, 0.0, 1.0, 0.0), ("s", 3, 0.0, 0.0, 1.0)], "sample_id string, nid bigint, x double, y double, z double")
    df = geometry.surface_measures(faces, points)
    assert "Broadcast" not in plan_of(df, capsys)
    r = df.first()
    assert (r["edges"], r["watertight"], r["winding_consistent"]) == (6, True, True) and r["volume"] == pytest.approx(1 / 6)
    # an edge of three faces isn't closed, and two faces that run along it alike are wound differently
    r = geometry.surface_measures(faces.union(spark.createDataFrame([("s", 0, 2, 3)], faces.schema)), points).first()
    assert (r["watertight"], r["winding_consistent"]) == (False, False)


def test_columns_of_a_solid_are_made_by_many_tasks(spark):
    from meshwright.plans import catalog

    s = spark.range(40).select(F.col("id").alias("s_suppkey"))
    p, tets = catalog._cubes(lambda name: s)
    v = geometry.voxelised(geometry.exterior_faces(tets), p, 0.25)
    assert v.groupBy(F.spark_partition_id()).count().count() > 4
    assert v.count() == sum((4 * (k % 7 + 1)) ** 3 for k in range(40))


def test_geometry_gate_judges_every_surface(spark, tmp_path):
    import __spark_entry__

    rows = [(585, 900.0, 5), (91, 900.0, 5), (118, 900.0, 5), (1, 900.0, 5)]  # 585 isn't closed, 91 is wound both ways
    spark.createDataFrame(rows, "p_partkey bigint, p_retailprice double, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = {r["p_partkey"]: r["pass"] for r in __spark_entry__.queries()["geometry_gate"](spark, str(tmp_path)).collect()}
    assert found == {585: False, 91: False, 118: True, 1: True}
