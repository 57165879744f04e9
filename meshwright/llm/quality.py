"""Quality rules: a threshold table compiled into one projection, without user functions.

Null and empty texts have no word, so the base rule rejects them; a very long text costs one row, never a
group. Ties and repeated rows are judged one by one; a null doc_id is passed through. Columns other than
doc_id and text are neither read nor able to clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import SPACE, table, words

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "au aux ce de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine er es im in ist mit nicht sie und von zu "
    "al con del el ella ellos en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document stays if ``low <= ratio <= high``; ``ratio`` is SQL over the counts of ``signals``."""

    name: str
    ratio: str
    low: float
    high: float


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols / n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.02, 1.0),
    Rule("duplicate_lines", "n_dup_lines / n_lines", 0.0, 0.6),
    Rule("line_words", "n_words / n_lines", 2.0, 1e9),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def signals(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the counts that rules use and the ``carried`` columns, one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", *carried, text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    gram = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    df = df.select(
        "doc_id",
        *carried,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), gram)).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    placed = F.array_sort(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("p", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed))
    same = lambda x, i: F.get("p", i).getField("g").eqNullSafe(x["g"])
    found = F.array_compact(F.transform("p", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])))
    df = df.drop("g").withColumn("starts", F.array_sort(found))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
    )["n"]
    # a filter on the result must not move below this step: it would evaluate the whole text anew for every word
    place = F.monotonically_increasing_id()
    return df.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")), "_place": place}).drop("p", "starts")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of ``signals`` breaks, as one array expression."""
    broken = [F.when(~F.coalesce(F.expr(f"try_divide({a}, {b})").between(r.low, r.high), F.lit(False)), F.lit(r.name)) for r in rules for a, b in [r.ratio.split(" / ")]]
    return F.array_compact(F.array(*broken))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *carried: str) -> DataFrame:
    """The signals, ``base_failed``, the names of the broken rules and the verdict ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = signals(docs, *carried).withColumn("base_failed", base).withColumn("broken", compiled(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0) & (F.col("_place") >= 0)).drop("_place")


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))
    return judged(row, rules, "_row").filter("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def _ratio(r: Rule) -> str:
    a, b = r.ratio.split(" / ")
    return f"coalesce({a} / nullif({b}, 0)::double between {r.low} and {r.high}, false)"


OP5_SQL = f"""
with d as (
  select doc_id, row_number() over () as k, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
g as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select k, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select k, i from (select *, count(*) over (partition by k, s) as n from g) where n > 1),
c as (select k, count(distinct j) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as j from r) group by k),
b as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::bigint as n_stop_words, len(l)::bigint as n_lines
  from d left join c using (k)),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(map(_ratio, RULES))} as kept, n_stop_words, n_lines
from v
"""
