"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder, but on one machine only."""
    path = spark.conf.get(DIR_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR_KEY} must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="meshwright-")
        spark.conf.set(DIR_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """How many tasks rows that will grow many times are dealt to: a count that is named is kept, however small they are now."""
    return 4 * spark.sparkContext.defaultParallelism


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The result survives lost executors and has no lineage of its own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
