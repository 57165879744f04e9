"""Optimal length buckets, and batches of a token budget inside each.

A text's length is its number of words. A dynamic program over the global histogram chooses the upper bounds of
``buckets`` buckets so that padding every text up to its bound costs the fewest tokens. Inside a bucket of bound
u, texts are numbered from 0 over all shards and ``max(1, budget // u)`` consecutive ones form a batch, so
only a bucket's last batch is short.

The histogram is exact. Its rows are the different lengths, which for w words in all are fewer than the root of 2w:
some 5,000 for a gigabyte of text, four million at most for 100 TB. Null and empty texts have length 0 and go to the shortest bucket; a null
doc_id is passed through; repeated rows are packed one by one. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm.common import table, words

BUCKETS, BUDGET = 12, 16_384


def bounds(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding.

    ``lengths`` ascend; ``counts`` and ``sums`` are the texts of each and their true words. A bucket over
    (i, j] costs lengths[j] * (C[j] - C[i]) - (S[j] - S[i]): lines in lengths[j], so each round of the
    program walks along a lower hull.
    """
    m = len(lengths)
    if not m:
        return []
    c, s = np.concatenate(([0], np.cumsum(counts))).tolist(), np.concatenate(([0], np.cumsum(sums))).tolist()
    u = [0, *lengths.tolist()]
    best, back = [0] + [math.inf] * m, []
    for _ in range(min(buckets, m)):
        new, come, hull, at = [math.inf] * (m + 1), np.zeros(m + 1, np.int32), [], 0
        if best[0] == 0:
            new[0] = 0
        for j in range(1, m + 1):
            if best[j - 1] < math.inf:
                line = (-c[j - 1], best[j - 1] + s[j - 1], j - 1)  # slopes fall
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * u[j] + hull[at + 1][1] <= hull[at][0] * u[j] + hull[at][1]:
                at += 1
            if hull:
                new[j], come[j] = hull[at][0] * u[j] + hull[at][1] + u[j] * c[j] - s[j], hull[at][2]
        back.append(come)
        best = new
    out, j = [], m
    for come in reversed(back):
        if j == 0:
            break
        out.append(u[j])
        j = int(come[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_length, batch_id (within the bucket) and slot (within the batch)."""
    rows = docs.select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n"), F.xxhash64("doc_id", "text").alias("h"))
    hist = rows.groupBy("n").agg(F.count("*").alias("c")).toArrow().sort_by("n")  # a row for each length
    n, c = hist["n"].to_numpy(), hist["c"].to_numpy()
    edges, total = bounds(n, c, n * c, buckets), int(c.sum())
    bucket = F.coalesce(*[F.when(F.col("n") <= e, F.lit(k)) for k, e in enumerate(edges)], F.lit(0))
    length = F.get(F.array(*[F.lit(e).cast("bigint") for e in edges or [0]]), F.col("bucket"))
    shards = max(1, math.isqrt(total))
    rows = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod("h", F.lit(shards)))
    # a row's number in its bucket: its number in its shard, after the sizes of the shards before
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n", "doc_id")) - 1
    rows = rows.withColumn("own", own).join(sizes, ["bucket", "shard"]).withColumn("bucket_length", length)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    place = F.col("own") + F.col("before")
    return rows.select("doc_id", F.col("n").alias("n_tokens"), "bucket", "bucket_length", F.floor(place / per).cast("bigint").alias("batch_id"), F.pmod(place, per).cast("bigint").alias("slot"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
