"""Source divergence audit: how far apart the sources of a language are in the terms that they use, and by which terms.

A group is a language and a source. Terms in at least ``MIN_DOCS`` documents of a language are kept there: V of them. With N
the group's occurrences of kept terms, each kept term has p = 1 + floor(10^9 (count + 2) / (N + 2 V)), whether the group
has it or not, and two groups differ by the sum over all kept terms of floor((p - q)^2 / (p + q)).

The sums are split by how many groups have a term. Heavy terms (in more than a quarter of a language's groups, or in more
than ``POSTINGS``) are dealt into tiles: a tile has about ``TILE`` terms and two blocks of ``BLOCK`` groups, as two dense
matrices of p. Light terms start from what two groups without the term differ by, V_light times, and are corrected where
postings are: by group, for terms that only one of two groups has (light terms of equal count count together), and by
pair, for two groups of one posting list. Both sums are integers and add up exactly.

Terms are counted before they are shuffled, a task's batches at a time; counts are dealt out by language and term, so a
large source or language is no task of its own. What is collected is a posting list of at most ``POSTINGS`` groups or a tile.

- A null text, lang or source is ''. Rows may repeat; each is a document. Columns other than these three are not read.
- A group without terms, or a language without kept terms, has pairs too (value 0 where V is 0). An empty table gives no rows.
- Very long texts and terms are read whole. Equal values rank by the item's UTF-8.
- Up to 9 x 10^15 occurrences of a language's terms are counted exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm.common import table
from meshwright.shared import written

#: Fixed by the contract: documents of a language that a kept term is in, and ranks of terms that are returned.
MIN_DOCS, TOP = 10, 10
#: Groups of a posting list at most; terms of a tile, about; groups of a block.
POSTINGS, TILE, BLOCK = 64, 512, 256
#: Groups up to which tables of groups and of languages (never more than groups) are broadcast; beyond that they are shuffled.
BROADCAST_GROUPS = 200_000
#: Distinct counted terms that a task holds before it passes them on.
_HELD = 400_000
#: Bytes of terms, A-Z in lower case; a blank for every other byte.
_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs): counts of a task's rows, passed on whenever enough are held."""
    occurring: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, counts in occurring.items():
            held, docs = list(counts), documents[key]
            for at in range(0, len(held), 50_000):
                part = held[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(part)), pa.array([key[1]] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "count", "docs"],
                )
        occurring.clear()
        documents.clear()

    for b in batches:
        text = b.column("text").cast(pa.binary() if pa.types.is_string(b.column("text").type) else pa.large_binary())
        for lang, source, t in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), text, strict=True):
            terms = t.as_py().translate(_BYTES).split()
            occurring.setdefault((lang, source), Counter()).update(terms)
            documents.setdefault((lang, source), Counter()).update(set(terms))
        if sum(map(len, occurring.values())) > _HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs, total, groups, first) of the kept terms of each language.

    docs, total and groups are the language's: documents and occurrences of the term, and sources that have it; first is true
    in one row for each language and term.
    """
    c = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    c = c.mapInArrow(_counted, "lang string, source string, term string, count bigint, docs bigint")
    c = c.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    c = c.select("*", F.sum("docs").over(w).alias("n_docs"), F.sum("count").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("groups"), (F.row_number().over(w.orderBy("source")) == 1).alias("first"))
    return c.filter(F.col("n_docs") >= MIN_DOCS).select("lang", "source", "term", "count", F.col("n_docs").alias("docs"), "total", "groups", "first")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)) in integers: three decimals at a time."""
    whole = n + 2 * v
    left, out = (count + 2).cast("bigint"), F.lit(0).cast("bigint")
    for step in range(4):
        out = out * 1000 + F.call_function("div", left, whole) if step else F.call_function("div", left, whole)
        left = (left % whole) * 1000
    return out + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, at, n, v, p0, q_n, members): every group, numbered in its language, and its share of a term that it lacks."""
    named = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source")]).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = counts.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("count").alias("q_n"))
    members = named.groupBy("lang").agg(F.count(F.lit(1)).alias("members"))
    g = named.join(sums, ["lang", "source"], "left").join(members, "lang").join(kept, "lang", "left")
    g = g.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "v", "q_n", "members")])
    at = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint")
    return g.select("*", at.alias("at"), F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.when(F.col("v") > 0, F.col("v")))).otherwise(0).alias("p0"))


def _tile(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of a tile's terms for the pairs of two blocks of groups: a < b. Terms that neither block has add the same each."""
    lang, _, a, b = key
    names, column = np.unique(terms["term"].to_numpy(), return_inverse=True)
    sides = {}
    for block in {a, b}:
        of = groups[groups["block"] == block].sort_values("at")
        dense = np.repeat(of["p0"].to_numpy()[:, None], len(names), axis=1)
        here = (terms["block"] == block).to_numpy()
        dense[np.searchsorted(of["at"].to_numpy(), terms["at"].to_numpy()[here]), column[here]] = terms["p"].to_numpy()[here]
        sides[block] = of["at"].to_numpy(), dense
    (ids, rows), (others, columns) = sides[a], sides[b]
    p0 = dict(zip(groups["at"], groups["p0"], strict=True))
    absent, p0_b = groups["terms"].iloc[0] - len(names), np.array([p0[o] for o in others])
    out = []
    for at, p in zip(ids, rows, strict=True):
        later = others > at
        out.append(pd.DataFrame({"lang": lang, "a": at, "b": others[later], "value": _difference(p, columns[later]).sum(axis=1) + absent * _difference(p0[at], p0_b[later])}))
    return pd.concat(out)


_PARTS = "lang string, a bigint, b bigint, value bigint"


def heavy_sums(heavy: DataFrame, groups: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(lang, a, b, value): partial sums of heavy terms (lang, term, at, p) by dense tiles; ``near`` is what is done to a table of groups that is joined."""
    blocks = groups.groupBy("lang").agg(F.floor((F.max("at")) / BLOCK).alias("last"))
    tiles = heavy.groupBy("lang").agg(F.ceil(F.count_if("first") / TILE).alias("tiles"))
    size = near(blocks.join(near(tiles), "lang"))
    block = F.floor(F.col("at") / BLOCK)
    every = F.sequence(F.lit(0).cast("bigint"), F.col("last"))
    pairs = F.explode(F.transform(every, lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"))))
    t = heavy.join(size, "lang").select("lang", "term", "at", "p", "last", block.alias("block"), F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"))
    t = t.select("lang", "term", "at", "p", "block", "tile", pairs.alias("pair")).select("lang", "tile", "pair.x", "pair.y", "term", "at", "p", "block")
    terms = heavy.filter("first").join(near(tiles), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile")).agg(F.count(F.lit(1)).alias("terms"))
    g = groups.join(near(blocks), "lang").join(terms, "lang").select("lang", "at", "p0", "last", block.alias("block"), "tile", "terms")
    g = g.select("lang", "at", "p0", "block", "tile", "terms", pairs.alias("pair")).select("lang", "tile", "pair.x", "pair.y", "at", "p0", "block", "terms")
    key = ["lang", "tile", "x", "y"]
    return t.groupBy(*key).cogroup(g.groupBy(*key)).applyInPandas(_tile, _PARTS)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of posting lists (lang, post: [(at, p, p0)]), added up over a batch."""
    for b in batches:
        post, langs = b.column("post"), np.array(b.column("lang").to_pylist(), dtype=object)
        flat = post.flatten()
        at, p, p0 = (flat.field(c).to_numpy() for c in ("at", "p", "p0"))
        sizes = np.asarray(post.value_lengths())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        sums: dict[tuple, int] = {}
        for size in np.unique(sizes[sizes > 1]):
            lists = np.flatnonzero(sizes == size)
            i, j = np.triu_indices(size, 1)
            for some in np.array_split(lists, -(-len(lists) * len(i) // 1_000_000)):
                left, right = (starts[some][:, None] + i).ravel(), (starts[some][:, None] + j).ravel()
                value = _difference(p[left], p[right]) - _difference(p[left], p0[right]) - _difference(p0[left], p[right]) + _difference(p0[left], p0[right])
                names, code = np.unique(langs[some].astype(str), return_inverse=True)
                keys = np.stack([np.repeat(code, len(i)), at[left], at[right]], axis=1)
                keys, to = np.unique(keys, axis=0, return_inverse=True)
                total = np.zeros(len(keys), dtype=np.int64)
                np.add.at(total, to.ravel(), value)
                for (lang, x, y), v in zip(keys, total, strict=True):
                    k = (names[lang], int(x), int(y))
                    sums[k] = sums.get(k, 0) + int(v)
        a = list(zip(*sums, strict=True)) if sums else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])


def light_sums(light: DataFrame, groups: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(lang, a, b, value): partial sums of light terms (lang, term, at, p, p0): a start for each pair, corrected by group and by pair."""
    many = light.groupBy("lang").agg(F.count_if("first").alias("light"))
    g = groups.join(near(many), "lang").select("lang", "at", "p0", "light")
    other = near(g.select("lang", F.col("at").alias("b"), F.col("p0").alias("q0")))
    start = g.join(other, "lang").filter("at < b").select("lang", F.col("at").alias("a"), "b", (F.col("light") * difference(F.col("p0"), F.col("q0"))).alias("value"))
    alike = light.groupBy("lang", "at", "p0", "p").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").filter("at <> b")
    alone = F.sum(F.col("m") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0"))))
    one = alike.groupBy("lang", F.least("at", "b").alias("a"), F.greatest("at", "b").alias("b")).agg(alone.alias("value"))
    lists = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "p", "p0"))).alias("post")).filter(F.size("post") > 1)
    two = lists.select("lang", "post").mapInArrow(_posted, _PARTS)
    return start.unionByName(one.select("lang", "a", "b", "value")).unionByName(two)


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each group's other sources, and the terms that set it apart."""
    counts = written(term_counts(docs), "divergence-counts")
    groups = written(groups_of(docs, counts), "divergence-groups")
    near = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda df: df
    t = counts.join(near(groups), ["lang", "source"]).select("lang", "source", "term", "first", "at", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("q_n"), F.col("v")).alias("q"), ((F.col("groups") * 4 > F.col("members")) | (F.col("groups") > POSTINGS)).alias("heavy"))
    t = written(t, "divergence-shares")
    pairs = heavy_sums(t.filter("heavy"), groups, near).unionByName(light_sums(t.filter("not heavy"), groups, near))
    zero = groups.select("lang", F.col("at").alias("a")).join(groups.select("lang", F.col("at").alias("b")), "lang").filter("a < b").withColumn("value", F.lit(0).cast("bigint"))
    pairs = pairs.unionByName(zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    name = lambda end, to: groups.select("lang", F.col("at").alias(end), F.col("source").alias(to))
    pairs = pairs.select("lang", "e.a", "e.b", "value").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    terms = t.filter("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the others of its language, and its ten most distinctive terms."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by 1, 2 having count(distinct doc) >= 10),
v as (select lang, count(*) as v from kept group by 1),
c as (select w.lang, w.source, w.term, count(*) as c from w join kept using (lang, term) group by 1, 2, 3),
g as (select distinct lang, source from d),
n as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by 1, 2),
p as (select n.lang, n.source, kept.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) as p
  from n join kept on kept.lang = n.lang join v on v.lang = n.lang left join c on c.lang = n.lang and c.source = n.source and c.term = kept.term),
l as (select lang, term, sum(c.c) as c from c group by 1, 2), ln as (select lang, sum(c) as n from l group by 1),
q as (select l.lang, l.term, 1 + (1000000000::hugeint * (l.c + 2)) // (ln.n + 2 * v.v) as q from l join ln using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
terms as (select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value from p join q on q.lang = p.lang and q.term = p.term where p.c > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, encode(item)))::int as rank from pairs
union all select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, encode(item)))::int from terms qualify row_number() over (partition by lang, source order by value desc, encode(item)) <= 10
"""
