"""Writes that are read back, and the ledger of what is finished."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEDGER = "sample_id string, stage string, status string, message string, at timestamp"


def _figures(df: DataFrame) -> list[Column]:
    """How many rows, and a digest of them that their order doesn't change; digests of unions are their digests' XOR."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("digest")]


def _digest(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(*_figures(df)).first())


def _written(df: DataFrame, write: Callable[[DataFrame], None]) -> tuple[int, int]:
    """The digest of what ``write`` writes, taken on the way: the plan runs once, so one that isn't repeatable does no harm."""
    seen = Observation()
    write(df.observe(seen, *_figures(df)))
    return seen.get["n"], seen.get["digest"]


def verified_write(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write Parquet in any mode and read it again; fails unless what was there (if appended to) and what was written come back."""
    spark = df.sparkSession
    before = (0, 0)
    if mode == "append":
        try:
            before = _digest(spark.read.parquet(path).select(df.columns))
        except AnalysisException:  # nothing there yet
            pass

    def write(rows: DataFrame) -> None:
        w = rows.write.mode(mode)
        (w.partitionBy(partition) if partition else w).parquet(path)

    if mode == "ignore":  # nothing may be written, and nothing counted
        write(df)
        return spark.read.parquet(path).select(df.columns)
    new = _written(df, write)
    back = spark.read.parquet(path).select(df.columns)
    if _digest(back) != (before[0] + new[0], before[1] ^ new[1]):
        raise ValueError(f"{path} differs from what was written")
    return back


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write CSV with a header and read it again as the same schema; fails unless the same rows come back (appended to others, unless all can be read)."""
    write = lambda rows: rows.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)
    new = write(df) if mode == "ignore" else _written(df, write)
    back = df.sparkSession.read.schema(df.schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if mode in ("errorifexists", "overwrite", "error") and _digest(back) != new:
        raise ValueError(f"{path} has other rows than were written")
    return back


def _archive(t: pa.Table) -> pa.Table:
    """One sample's arrays (name, shape, values) as an NPZ archive."""
    arrays = {n: np.array(v, float).reshape(s) for n, s, v in zip(*(t.column(c).to_pylist() for c in ("name", "shape", "values")), strict=True)}
    f = io.BytesIO()
    np.savez(f, **arrays)
    with zipfile.ZipFile(f, "a") as z:  # the archive's comment is the line end that a text writer adds
        z.comment = b"\n"
    return pa.table({"sample_id": t.column("sample_id").slice(0, 1), "content": pa.array([f.getvalue()[:-1]], pa.binary())})


def _rows_of_arrays(arrays: DataFrame) -> DataFrame:
    return arrays.select(F.col("sample_id").cast("string").alias("sample_id"), "name", F.col("shape").cast("array<bigint>").alias("shape"), F.col("values").cast("array<double>").alias("values"))


#: Bytes of archives after which a bundle is full.
BUNDLE = 16 << 20
#: The name of the archive of arrays without a sample, which no sample's can have.
UNNAMED = "%"


def _bundled(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    """Bundles of NPZ archives, from arrays in order of samples: a ZIP archive whose members are ``sample_id.npz``."""

    def closed(z: zipfile.ZipFile, f: io.BytesIO) -> pa.RecordBatch:
        z.comment = b"\n"  # the line end that a text writer adds
        z.close()
        return pa.RecordBatch.from_arrays([pa.array([f.getvalue()[:-1]], pa.binary())], ["content"])

    def added(z: zipfile.ZipFile, sample: str | None, arrays: dict[str, np.ndarray]) -> None:
        one = io.BytesIO()
        np.savez(one, **arrays)
        z.writestr(zipfile.ZipInfo(f"{UNNAMED if sample is None else quote(sample, safe='')}.npz"), one.getbuffer())

    f = z = None
    last, arrays = None, {}
    for batch in batches:
        for sample, name, shape, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if z is None:
                f = io.BytesIO()
                z = zipfile.ZipFile(f, "w")
            if arrays and sample != last:
                added(z, last, arrays)
                arrays = {}
                if f.tell() >= full:
                    yield closed(z, f)
                    f = io.BytesIO()
                    z = zipfile.ZipFile(f, "w")
            last = sample
            arrays[name] = values.values.to_numpy(zero_copy_only=False).reshape(shape)
    if arrays:
        added(z, last, arrays)
        yield closed(z, f)


def npz_bundles(arrays: DataFrame, path: str, full: int = BUNDLE) -> None:
    """Rows (sample_id, name, shape, values: row by row) as an NPZ archive for each sample, many of them in a ZIP file.

    A file has up to about ``full`` bytes, so files grow in number with the bytes and not with the samples.
    """
    rows = _rows_of_arrays(arrays).repartition("sample_id").sortWithinPartitions("sample_id")
    bundles = rows.mapInArrow(partial(_bundled, full=full), "content binary")
    bundles.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def npz(arrays: DataFrame, path: str) -> None:
    """Rows (sample_id, name, shape, values: row by row) as an NPZ archive in a folder for each sample."""
    rows = _rows_of_arrays(arrays)
    files = rows.groupBy("sample_id").applyInArrow(_archive, "sample_id string, content binary")
    # a binary column cast to text is written as it is
    one = files.select("sample_id", F.col("content").cast("string").alias("value")).repartition("sample_id")
    one.write.option("maxRecordsPerFile", 1).partitionBy("sample_id").text(path)


def ordered_text(lines: DataFrame, order: list[str], path: str) -> None:
    """The column text as text files whose names and lines keep the order; each file is a range of it."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("text").write.text(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Add (sample_id, stage, status, message) rows, with the time."""
    rows.select("sample_id", "stage", "status", "message", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last ledger row of each sample and stage."""
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy("sample_id", "stage").agg(F.max_by(F.struct("status", "message"), "at").alias("x")).select("sample_id", "stage", "x.*")


def pending(samples: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    """Samples that have no success in a stage."""
    done = ledger.filter((F.col("stage") == stage) & (F.col("status") == "SUCCESS")).select("sample_id")
    return samples.join(done, "sample_id", "left_anti")


def documents(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
