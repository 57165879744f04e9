"""Tables from CSV, JSON, NPZ, ZIP, STL files; files are found, split and read by Spark."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def csv(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """One or more CSV files with a header; a row that doesn't fit the schema fails."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nanValue", "nan").csv(list(paths))


def documents(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """JSON documents, one a file; what can't be read has its text in ``_corrupt`` and nulls elsewhere."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths), multiLine=True)


def found(spark: SparkSession, pattern: str, *roots: str) -> DataFrame:
    """Files by name under one or more roots, each once: path, length, modificationTime, root (its number) and place.

    ``place`` 1 is the preferred one of a file name: from the first root that has it, then the shortest path.
    """
    out = None
    for k, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        files = files.select("path", "length", "modificationTime", F.lit(k).alias("root"))
        out = files if out is None else out.unionByName(files)
    once = out.groupBy("path").agg(F.min("length").alias("length"), F.min("modificationTime").alias("modificationTime"), F.min("root").alias("root"))
    w = Window.partitionBy(F.element_at(F.split("path", "/"), -1)).orderBy("root", F.length("path"), "path")
    return once.withColumn("place", F.row_number().over(w))


def missing_markers(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(folder, missing): the folders under a root that have some of the named files, and those they lack."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", "^(.*)/([^/]*)$", 1).alias("folder"), F.regexp_extract("path", "^(.*)/([^/]*)$", 2).alias("name"))
    have = files.groupBy("folder").agg(F.collect_set("name").alias("have"))
    lack = F.filter(F.array(*[F.lit(n) for n in names]), lambda x: ~F.array_contains("have", x))
    return have.filter(F.arrays_overlap("have", F.array(*[F.lit(n) for n in names]))).select("folder", lack.alias("missing"))


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _npz_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for key in z.files:
                        a = np.atleast_1d(z[key])
                        number = np.issubdtype(a.dtype, np.number)
                        yield pd.DataFrame({"path": [path], "key": [key], "shape": [list(a.shape)], "finite": [bool(np.isfinite(a).all()) if number else None], "values": [a.astype(float).ravel() if number else None], "error": [None]})
            except (ValueError, OSError, zipfile.BadZipFile) as x:
                yield pd.DataFrame({"path": [path], "key": [None], "shape": [None], "finite": [None], "values": [None], "error": [str(x)]})


def npz(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """Arrays of NPZ files, one a row: path, key, shape, finite, values (row by row), error (unreadable files)."""
    return _binary(spark, path, pattern).mapInPandas(_npz_rows, "path string, key string, shape array<bigint>, finite boolean, values array<double>, error string")


_ARRAYS = "path string, sample_id string, key string, shape array<bigint>, finite boolean, values array<double>, error string"


def _bundle_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.float64()), pa.string()]
    names = ["path", "sample_id", "key", "shape", "finite", "values", "error"]

    def arrays(path: str, content: bytes) -> Iterator[tuple]:
        try:
            bundle = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as x:
            yield path, None, None, None, None, None, str(x)
            return
        with bundle:
            for m in bundle.infolist():
                name = m.filename.removesuffix(".npz")
                sample = None if name == "%" else unquote(name)
                try:
                    with np.load(io.BytesIO(bundle.read(m)), allow_pickle=False) as z:
                        for key in z.files:
                            a = np.atleast_1d(z[key])
                            number = np.issubdtype(a.dtype, np.number)
                            yield path, sample, key, list(a.shape), bool(np.isfinite(a).all()) if number else None, a.astype(float).ravel() if number else None, None
                except (ValueError, OSError, zipfile.BadZipFile) as x:
                    yield path, sample, None, None, None, None, str(x)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            of = arrays(path, content.as_py())
            while some := list(islice(of, rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*some, strict=True), types, strict=True)], names)


def npz_bundles(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """Arrays of bundles of NPZ archives (``sinks.npz_bundles``), one a row: path, sample_id, key, shape, finite, values, error (what can't be read)."""
    return _binary(spark, path, pattern).mapInArrow(_bundle_rows, _ARRAYS)


def _npy_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            row = {"path": [path], "shape": [None], "values": [None], "error": [None]}
            try:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                row |= {"shape": [list(a.shape)], "values": [a.astype(float).ravel()]}
            except (ValueError, OSError, EOFError) as x:
                row["error"] = [str(x)]
            yield pd.DataFrame(row)


def npy(spark: SparkSession, path: str) -> DataFrame:
    """NPY files, one array a row: path, shape, values (row by row), error (unreadable files)."""
    return _binary(spark, path, "*.npy").mapInPandas(_npy_rows, "path string, shape array<bigint>, values array<double>, error string")


def npz_probe(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: whether it reads and is finite, its keys and the error."""
    return npz(spark, path).groupBy("path").agg(F.bool_and(F.col("error").isNull()).alias("ok"), F.array_sort(F.collect_list("key")).alias("keys"), F.bool_and("finite").alias("finite"), F.first("error", True).alias("error"))


def _zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                yield pd.DataFrame({"path": [path], "member": [None], "ok": [False], "content": [None]})
                continue
            with archive as z:
                for m in z.infolist():
                    safe = not m.filename.startswith("/") and ".." not in m.filename.split("/")
                    if not m.is_dir():
                        try:
                            data = z.read(m) if safe else None
                        except zipfile.BadZipFile:
                            safe, data = False, None
                        yield pd.DataFrame({"path": [path], "member": [m.filename], "ok": [safe], "content": [data]})


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP archives: path, member, ok (intact, and named inside the archive), content; a broken archive is one row."""
    return _binary(spark, path, "*.zip").mapInPandas(_zip_rows, "path string, member string, ok boolean, content binary")


def _stl_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    record = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            (n,) = struct.unpack("<I", content[80:84]) if len(content) >= 84 else (0,)
            if len(content) == 84 + record.itemsize * n and n:
                v = np.frombuffer(content, record, n, 84)["v"].astype(float)
            else:  # text: three vertices for each facet
                words = [line.split()[1:] for line in content.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]]
                v = np.array(words, float).reshape(-1, 3, 3)
                n = len(v)
            yield pd.DataFrame({"path": path, "face": np.repeat(np.arange(n), 3), "corner": np.tile(np.arange(3), n), "x": v[:, :, 0].ravel(), "y": v[:, :, 1].ravel(), "z": v[:, :, 2].ravel()})


def stl(spark: SparkSession, path: str) -> DataFrame:
    """Corners of binary and text STL files' faces; equal (x, y, z) are one vertex (``merged``)."""
    return _binary(spark, path, "*.stl").mapInPandas(_stl_rows, "path string, face bigint, corner int, x double, y double, z double")


def merged(corners: DataFrame) -> DataFrame:
    """Faces over merged vertices: a vertex is the hash of its position in its file."""
    v = F.xxhash64("path", "x", "y", "z")
    return corners.groupBy("path", "face").agg(*[F.max(F.when(F.col("corner") == k, v)).alias(n) for k, n in enumerate("abc")])
