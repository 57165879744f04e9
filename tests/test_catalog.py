"""Every query of the catalogue against its SQL in DuckDB; those without SQL give rows."""

import glob
import os

import duckdb
import pytest

from meshwright.plans import catalog, learning, rules, voxels  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    rel = db.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
    if got != want:  # a sum in another order may differ in the sixth place
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            for a, b in zip(g, w, strict=True):
                assert a == b or float(a) == pytest.approx(float(b), abs=2e-6, rel=1e-9)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
