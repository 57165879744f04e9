"""The corpus pipeline: quality rules, near-duplicates, substrings, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

A document is a doc_id with a text. Null and empty texts are rejected by the first stage. Texts without a doc_id, or of
one doc_id, are documents of their own in every stage; rows that repeat both are one document to near-duplicates, which
keeps one of them. Columns beyond those of documents are passed through, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import decontaminate, packing, quality, simhash, substring
from meshwright.llm.common import table
from meshwright.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies: Jaccard similarity of 0.8 or more on 5-word shingles.

    A document is a doc_id with a text: texts without or of one doc_id are documents of their own.
    """
    found = simhash.near_copies(docs, 0.8)
    least = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "content")).alias("at"))
    first = least.select(F.col("at.doc_id").alias("first"), F.col("at.content").alias("content"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("content")), "left_semi")
    return rows.dropDuplicates(["doc_id", "key"]).select("row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier start has, if words are left."""
    rows = substring.numbered(docs.select(F.struct("*").alias("row"), "doc_id", "text"), "doc")
    left = substring.judged(rows.select("doc", "doc_id", "text"))
    left = left.select("doc", F.col("kept").cast("string").alias("kept")).filter("kept <> ''").dropDuplicates(["doc"])
    # a row travels without its text, which another takes the place of
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    rows = rows.select("doc", F.col("row").dropFields("text").alias("row")).join(left, "doc")
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents (a doc_id with a text) that no benchmark item contaminates."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = decontaminate.contaminated(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.drop("text").join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Similar groups and optimal buckets are beyond SQL; a test holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
