"""URL filters: host and path rules, then a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, are learned from the URLs that a rule
decides, after Witten and Bell: the estimate of order k, n(context, c) + m(context) times that of order k - 1,
over n(context) + m(context), where m counts the characters seen after the context; order 0 rests on the uniform
distribution. A URL's score is the difference of its log-likelihoods, per character; the threshold is the score
that separates the learned URLs with the fewest errors of both kinds. URLs are counted once, however many pages have them.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is scored by what it
holds (null and empty: 0). If only one side has URLs to learn from, all scores are 0 and everything is allowed.
Rows that repeat are judged alike; a null page_id is passed through. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import lower_ascii, table
from meshwright.shared import written

#: Host, path start, verdict (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 4
BINS = 200  # of scores, for each unit
#: Grams of the models that are broadcast, at most; beyond that the grams of URLs meet them in a shuffled join.
BROADCAST_ROWS = 200_000
_START = "\x02"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def ruled(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict (null: none fits)."""
    host, path = parts(F.col("url"))
    df = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    fits = [(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = F.coalesce(*[F.when(f, F.lit(name)) for f, name, _ in fits])
    return df.withColumn("rule", rule).withColumn("verdict", F.coalesce(*[F.when(F.col("rule") == name, F.lit(v)) for _, name, v in fits]))


def _grams(urls: DataFrame) -> DataFrame:
    """url and each of its characters with the ORDER before it, counted."""
    padded = F.concat(F.lit(_START * ORDER), F.lower("url"))
    g = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.filter("url <> ''").select(*urls.columns, F.explode(g).alias("g"))


def models(urls: DataFrame) -> DataFrame:
    """g (a character after its context) and llr: the difference of the models' log10 probabilities.

    ``urls``: distinct (url, verdict), where a null verdict is not learned from.
    """
    side = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    level = written(_grams(urls).groupBy("g").agg(side("allow").alias("a"), side("block").alias("b")), "url-grams")
    levels = [level]
    for _ in range(ORDER):
        level = level.groupBy(F.substring("g", 2, ORDER).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        levels.append(level)
    known = None
    for level in reversed(levels):
        level = level.withColumn("ctx", F.expr("substring(g, 1, length(g) - 1)"))
        kinds = lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(f"m{c}")
        ctx = level.groupBy("ctx").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), kinds("a"), kinds("b"))
        level = level.join(ctx, "ctx")
        if known is None:
            size = level.agg(F.count("*").alias("size"))  # one row: the alphabet
            level = level.crossJoin(F.broadcast(size)).withColumns({"pa": 1 / F.col("size"), "pb": 1 / F.col("size")})
        else:
            level = level.withColumn("s", F.expr("substring(g, 2)")).join(known, "s")
        p = {x: F.when(F.col(f"n{x}") == 0, F.col(f"p{x}")).otherwise((F.col(x) + F.col(f"m{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"m{x}"))) for x in "ab"}
        known = level.select(F.col("g").alias("s"), p["a"].alias("pa"), p["b"].alias("pb"))
    return known.select(F.col("s").alias("g"), (F.log10("pa") - F.log10("pb")).alias("llr"))


def scores(urls: DataFrame) -> DataFrame:
    """url and score: the models' log-likelihood difference per character."""
    known = written(models(urls), "url-model")
    met = _grams(urls.select("url")).join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "g")
    return met.groupBy("url").agg((F.sum("llr") / F.count("*")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score from which URLs are allowed: the bin with the fewest errors of both kinds, in shares of each side."""
    rows = scored.filter("verdict is not null").groupBy(F.floor(F.col("score") * BINS).alias("bin"), "verdict").count().collect()  # bounded by the range of scores
    n = {v: sum(r["count"] for r in rows if r["verdict"] == v) for v in ("allow", "block")}
    if not all(n.values()):
        return float("-inf")
    cuts = sorted({r["bin"] for r in rows} | {r["bin"] + 1 for r in rows})
    wrong = lambda c: sum(r["count"] / n[r["verdict"]] for r in rows if (r["bin"] >= c) == (r["verdict"] == "block"))
    low = min(map(wrong, cuts))
    best = [c for c in cuts if wrong(c) <= low + 1e-12]
    return best[len(best) // 2] / BINS


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score, one row for each input row."""
    df = ruled(pages)
    # as many files as there are partitions: each row becomes a row for each character
    urls = written(df.select("url", "verdict").distinct().repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url"), "urls")
    scored = written(urls.join(scores(urls), "url", "left").select("url", "verdict", F.coalesce("score", F.lit(0.0)).alias("score")), "url-scores")
    cut = threshold(scored)
    known = scored.select("url", "score")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return df.join(known, "url").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
