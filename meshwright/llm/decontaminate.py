"""Benchmark decontamination by templates, in DataFrame functions only.

Punctuation goes; a word with a digit becomes <num>, a unit after a number <unit>, a capitalised word <name>,
and the rest is lower-cased. Windows of ``WINDOW`` template words of each benchmark item (of the whole item if
it is shorter) are hash-joined with the windows of every document. Slots must then be consistent: along one
alignment of an item with a document, each benchmark value stands for one document value throughout. That
catches re-parameterised questions as well as exact copies.

A document is contaminated by an item if consistent alignments cover half of the item's windows, or
``ENOUGH`` of them. Templates with fewer than ``LITERALS`` words that aren't placeholders (or than half of a
short window) say nothing and don't count. Windows of the lower-cased words themselves are joined too, all of an item's
with all of a document's, so copies match whatever their literals and case, by the same share of all of the item's windows.
What is found of an item does not depend on other items.

A word is hashed once, and windows are put together from hashes of halves, so that both kinds of windows cost little.

Null and empty texts match nothing, as does an empty benchmark. A document is a doc_id with a text, and an item an item_id
with a text: rows that repeat both count once, and texts without an id or of one id are documents, or items, of their own
(``contaminated`` gives each its rows). Of either table only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm.common import SPACE, table
from meshwright.shared import written

WINDOW, LITERALS, ENOUGH = 8, 4, 6
#: Benchmark windows that are broadcast, at most; beyond that the windows meet in a shuffled join.
BROADCAST_ROWS = 100_000
#: Bits that mark hashes of benchmark windows (a megabyte).
MARKS = 1 << 23
#: Units of measure (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years percent dollar dollars euro euros cent cents meter meters metre metres mile miles "
    "gram grams liter liters litre litres kmh mph hz khz mhz ghz w kw v a kb mb gb tb c f k"
).split()


def templates(rows: DataFrame, *key: str) -> DataFrame:
    """The key columns, w (the words without punctuation), t (their template words) and l (the words lower-cased), of equal length."""
    clean = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    t = F.regexp_replace("c", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{N}]*\p{N}[^\x20\x09-\x0D]*", "<num>")
    t = F.regexp_replace(t, rf"(?<=<num>[\x20\x09-\x0D])(?:{'|'.join(UNITS)})(?![^\x20\x09-\x0D])", "<unit>")
    t = F.regexp_replace(t, r"(?<![^\x20\x09-\x0D])\p{Lu}[^\x20\x09-\x0D]*", "<name>")
    df = rows.select(*key, clean.alias("c")).select(*key, "c", F.lower(t).alias("t"), F.lower("c").alias("l"))
    split = lambda c: F.array_remove(F.split(c, SPACE), "")
    return df.select(*key, split("c").alias("w"), split("t").alias("t"), split("l").alias("l"))


def _pieces(rows: DataFrame, keep: list[str], sizes: dict[str, set[int]]) -> DataFrame:
    """The columns ``keep`` with t1, t2, t4 and l1, l2, l4 as far as ``sizes`` needs them: hashes of all runs of 1, 2 and 4 words.

    Each is a step of its own, as what a step uses twice would else be made twice.
    """
    most = {of: max(n) for of, n in sizes.items() if n}
    rows = rows.select(*keep, *[F.transform(of, lambda x: F.xxhash64(x)).alias(f"{of}1") for of in most])
    for half in (1, 2):
        have = [c for c in rows.columns if c not in keep]
        rows = rows.select(*keep, *have, *[_beside(f"{of}{half}", f"{of}{half}", half).alias(f"{of}{2 * half}") for of, n in most.items() if n > half])
    return rows


def _beside(a: str, b: str, after: int, *seed: Column) -> Column:
    """Each hash of the column a with that of b, ``after`` words on, as one hash."""
    n = F.greatest(F.size(b) - after, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, after + 1, n), lambda x, y: F.xxhash64(*seed, x, y))


def _windows(size: int, of: str) -> Column:
    """The hashes of all windows of ``size`` words of the column t, or of l (the lower-cased words), from ``_pieces``."""
    seed = F.lit(size if of == "t" else -size)
    if size == 1:
        return F.transform(f"{of}1", lambda x: F.xxhash64(seed, x))
    if size in (3, 5, 6, 8):
        half = {3: 2, 5: 4, 6: 4, 8: 4}[size]
        return _beside(f"{of}{half}", f"{of}{size - half}", half, seed)
    if size == 7:  # two runs of four, which share a word
        return _beside(f"{of}4", f"{of}4", 3, seed)
    return F.transform(f"{of}{size}", lambda x: F.xxhash64(seed, x))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a hash of its id and text), size, j (start), h (hash), exact (of the words, not of the template), places and values of the slots, total (such windows of the item)."""
    named = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("item_id", "text").alias("item"))
    b = templates(named, "item_id", "item").filter("size(t) > 0").dropDuplicates(["item_id", "item"]).withColumn("size", F.least(F.size("t"), F.lit(WINDOW)))
    every = set(range(1, WINDOW + 1))
    b = written(_pieces(b, ["item_id", "item", "size", "w", "t"], {"t": every, "l": every}), "template-pieces")
    sized = lambda of: F.coalesce(*[F.when(F.col("size") == n, _windows(n, of)) for n in every])
    b = b.select("item_id", "item", "size", "w", "t", F.arrays_zip(sized("t").alias("h"), sized("l").alias("copy")).alias("x"))
    b = b.select("item_id", "item", "size", "w", "t", F.posexplode_outer("x").alias("j", "x")).select("item_id", "item", "size", "w", "t", "j", "x.*")
    b = b.withColumn("t", F.slice("t", F.col("j") + 1, F.col("size"))).withColumn("w", F.slice("w", F.col("j") + 1, F.col("size")))
    b = b.withColumn("places", F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.get("t", k).isin("<num>", "<unit>", "<name>")))
    says = F.col("size") - F.size("places") >= F.least(F.lit(LITERALS), F.ceil(F.col("size") / 2))
    copies = b.select("item_id", "item", "size", "j", F.col("copy").alias("h"), F.lit(True).alias("exact"), F.slice("places", 1, 0).alias("places"), F.slice("w", 1, 0).alias("asked"))
    b = b.filter(says).select("item_id", "item", "size", "j", "h", F.lit(False).alias("exact"), "places", F.transform("places", lambda k: F.get("w", k)).alias("asked")).union(copies)
    return b.join(b.groupBy("item", "exact").agg(F.count("*").alias("total")), ["item", "exact"])


#: What tells documents apart: two hashes of a doc_id with its text.
_DOC = ("doc_id", "doc_a", "doc_b")


def _marks(bench: DataFrame) -> DataFrame:
    """One row: ``marks``, as bits, where the hashes of benchmark windows lie; of a fixed size."""
    at = F.shiftright(F.col("h").bitwiseAND(F.lit(MARKS - 1)), 6)
    bits = bench.groupBy(at.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    every = bench.sparkSession.range(MARKS >> 6).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("x"))
    return every.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.transform("x", lambda x: x["bits"]).alias("marks"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, doc_a, doc_b, item_id, item, exact, diagonal, j and the slots (asked, found) of every window that both share.

    Windows meet without their words. The words of slots come after, from the documents that have such a match.
    """
    bench = written(benchmark_windows(benchmark), "template-bench")
    sizes = {(r["size"], r["exact"]): r["n"] for r in bench.groupBy("size", "exact").agg(F.count("*").alias("n")).collect()}  # 16 rows at most
    few = sum(sizes.values()) <= BROADCAST_ROWS
    # the condition always holds; with it, Spark hashes a text once, where it would do so anew for each of its windows
    once = lambda h: F.when(F.monotonically_increasing_id() >= 0, h)
    named = docs.select("doc_id", "text", once(F.xxhash64("doc_id", "text")).alias("doc_a"), once(F.xxhash64(F.lit(1), "text", "doc_id")).alias("doc_b"))
    kinds = sorted(sizes)
    d = templates(named, *_DOC).withColumn("n", F.size("t"))
    d = _pieces(d, [*_DOC, "n"], {of: {n for n, exact in kinds if exact == (of == "l")} for of in ("t", "l")})
    every = F.concat(*[_windows(n, "l" if exact else "t") for n, exact in kinds]) if kinds else F.array().cast("array<bigint>")
    # a window's place among those of its kind: those of the kinds before it come first
    before, starts = F.lit(0), []
    for n, exact in kinds:
        starts.append(F.when((F.col("size") == n) & (F.col("exact") == exact), before))
        before = before + F.greatest(F.col("n") - (n - 1), F.lit(0))
    place = (F.col("pos") - F.coalesce(*starts, F.lit(0))).alias("i")
    # outer: else Spark infers a filter on the windows and evaluates all templates anew for each of them
    if few:
        at = d.select(*_DOC, "n", every.alias("x")).select(*_DOC, "n", F.posexplode_outer("x").alias("pos", "h"))
    else:  # windows that the benchmark doesn't mark go before rows are made of them
        marked = lambda h: F.call_function("shiftright", F.get("marks", F.shiftright(h.bitwiseAND(F.lit(MARKS - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        d = d.select(*_DOC, "n", every.alias("x")).crossJoin(F.broadcast(_marks(bench)))
        d = d.select(*_DOC, "n", F.filter(F.transform("x", lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), lambda x: marked(x["h"])).alias("x"))
        at = d.select(*_DOC, "n", F.explode_outer("x").alias("x")).select(*_DOC, "n", "x.*")
    met = at.join(F.broadcast(bench) if few else bench, "h")
    met = written(met.select(*_DOC, "item_id", "item", "exact", place, "j", "total", "places", "asked"), "template-matches")
    slot = F.array(F.struct(F.lit("").alias("asked"), F.lit("").alias("found")))
    plain = met.filter("size(places) = 0").select(*_DOC, "item_id", "item", "exact", (F.col("i") - F.col("j")).alias("diagonal"), "j", "total", F.slice(slot, 1, 0).alias("slots"))
    asking = met.filter("size(places) > 0").groupBy(*_DOC).agg(F.collect_list(F.struct("item_id", "item", "exact", "i", "j", "total", "places", "asked")).alias("m"))  # a document's matches
    asking = written(asking, "template-slots")
    need = asking.select("doc_a", "doc_b")
    text = named.join(F.broadcast(need) if need.count() <= BROADCAST_ROWS else need, ["doc_a", "doc_b"], "left_semi").dropDuplicates(["doc_a", "doc_b"])
    both = asking.join(templates(text, "doc_a", "doc_b").drop("t", "l"), ["doc_a", "doc_b"])
    found = lambda x: F.zip_with(x["places"], x["asked"], lambda k, a: F.struct(a.alias("asked"), F.get("w", x["i"] + k).alias("found")))
    slots = F.transform("m", lambda x: F.struct(x["item_id"].alias("item_id"), x["item"].alias("item"), x["exact"].alias("exact"), (x["i"] - x["j"]).alias("diagonal"), x["j"].alias("j"), x["total"].alias("total"), found(x).alias("slots")))
    return plain.union(both.select(*_DOC, slots.alias("m")).select(*_DOC, F.explode("m").alias("m")).select(*_DOC, "m.*"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (covered consistently), n_item_windows and n_changed (slots with another value)."""
    return contaminations(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_item_windows", "n_changed")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contaminated`` returns, with doc_a and doc_b."""
    along = matches(docs, benchmark).groupBy(*_DOC, "item_id", "item", "exact", "diagonal", "total").agg(
        F.collect_set("j").alias("js"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["asked"])))
    along = along.filter(consistent).withColumn("changed", F.size(F.filter("slots", lambda s: s["asked"] != s["found"])))
    found = along.groupBy(*_DOC, "item_id", "item", "exact", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("js")))).cast("bigint").alias("n_windows"), F.min("changed").cast("bigint").alias("n_changed")
    )
    found = found.filter(F.col("n_windows") >= F.least(F.lit(ENOUGH), F.ceil(F.col("total") / 2)))
    # what its template says of an item goes before what its words say
    one = found.groupBy(*_DOC, "item_id", "item").agg(F.min(F.struct("exact", "n_windows", F.col("total").alias("n_item_windows"), "n_changed")).alias("x"))
    return one.select(*_DOC, "item_id", "x.n_windows", "x.n_item_windows", "x.n_changed")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _template_sql(name: str, key: str) -> str:
    """The templates of a table in DuckDB, word by word."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
{name}_w as (select {key}, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {name}),
{name}_t as (select {key}, w, list_transform(w, lambda x, i: case
    when regexp_matches(x, '\\p{{N}}') then '<num>'
    when i > 1 and regexp_matches(w[i - 1], '\\p{{N}}') and x in ({units}) then '<unit>'
    when regexp_matches(x, '^\\p{{Lu}}') then '<name>' else lower(x) end) as t from {name}_w)"""


OP1_SQL = f"""
with {_template_sql("documents", "doc_id")}, {_template_sql("benchmark", "item_id")},
b0 as (select item_id, w, t, list_transform(w, lambda x: lower(x)) as l, least(len(t), {WINDOW}) as size from benchmark_t where len(t) > 0),
b1 as (select item_id, size, j, t[j : j + size - 1] as t, l[j : j + size - 1] as l, w[j : j + size - 1] as w from (select *, unnest(range(1, len(t) - size + 2)) as j from b0)),
b2 as (select *, list_filter(range(1, size + 1), lambda k: t[k] in ('<num>', '<unit>', '<name>')) as places from b1),
b3 as (select item_id, size, j, false as exact, w, places, array_to_string(t, ' ') as s from b2 where size - len(places) >= least({LITERALS}, ceil(size / 2))
  union all select item_id, size, j, true, w, [], array_to_string(l, ' ') from b2),
b as (select *, count(*) over (partition by item_id, exact) as total from b3),
d0 as (select doc_id, size, e as exact, case when e then list_transform(w, lambda x: lower(x)) else t end as c from documents_t, (select distinct size from b), (values (false), (true)) e(e)),
d1 as (select doc_id, size, exact, unnest(list_transform(range(1, len(c) - size + 2), lambda i: {{'i': i, 's': array_to_string(c[i : i + size - 1], ' ')}})) as x from d0),
d as (select doc_id, size, exact, x.i as i, x.s as s from d1),
m0 as (select doc_id, item_id, exact, i, j, total, places, b.w as asked from d join b using (s, size, exact)),
m as (select doc_id, item_id, exact, i - j as diagonal, j, total, list_transform(places, lambda k: [asked[k], w[i + k - 1]]) as slots from m0 join documents_t using (doc_id)),
x as (select doc_id, item_id, exact, diagonal, total, list(distinct j) as js, list_distinct(flatten(list(slots))) as slots from m group by all),
y as (select *, len(list_filter(slots, lambda s: s[1] <> s[2])) as changed from x where len(slots) = len(list_distinct(list_transform(slots, lambda s: s[1])))),
z as (select doc_id, item_id, exact, total, len(list_distinct(flatten(list(js))))::bigint as n_windows, min(changed)::bigint as n_changed from y group by all)
select doc_id, item_id, n_windows, total::bigint as n_item_windows, n_changed from z where n_windows >= least({ENOUGH}, ceil(total / 2))
qualify row_number() over (partition by doc_id, item_id order by exact, n_windows, total, n_changed) = 1
"""
