"""Solver text: section reports, id sets of decks, and decks as ordered lines.

Input lines are rows (file, line, text); everything here is windows and joins over them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.ordering import positioned

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?"
#: Words of a section's head line, and its name (fixed values).
SECTIONS = {"forces": "reaction", "stresses": "stress", "strains": "strain"}


#: Lines of a file that a task looks at together; what it needs of those before comes from a row for each such piece.
PIECE = 1 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, lines from 0. A large file is read by several tasks.

    A task reads byte ranges of files, in order. Lines are numbered within a range, and ranges by what all before them
    hold: counting those reads the files once more.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("text"))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    ranges = rows.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "_at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(ranges, ["file", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "text")


def _carried(df: DataFrame, within: Column, all_of: Column, before: Callable[[Column], Column], both: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``df`` with ``name``: something that goes on from line to line of a file, piece by piece.

    ``within``: its value at a line, of the lines of its piece up to there. ``all_of``: an aggregate of a whole piece;
    ``before``: the same of all earlier pieces' values; ``both``: what these and the value within a piece come to.
    """
    df = df.withColumn("_piece", F.floor(F.col("line") / PIECE))
    earlier = Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = df.groupBy("file", "_piece").agg(all_of.alias("_all")).select("file", "_piece", before(F.col("_all")).over(earlier).alias("_before"))
    w = Window.partitionBy("file", "_piece").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_within", within.over(w)).join(pieces, ["file", "_piece"]).withColumn(name, both(F.col("_before"), F.col("_within"))).drop("_piece", "_before", "_within")


def numbers(df: DataFrame) -> DataFrame:
    """rows with ``numbers``: those in the text, with Fortran exponents read as such."""
    found = F.regexp_extract_all("text", F.lit(NUMBER), 0)
    return df.withColumn("numbers", F.transform(found, lambda x: F.replace(F.upper(x), F.lit("D"), F.lit("E")).cast("double")))


def heads(df: DataFrame, n: int) -> DataFrame:
    """(file, head, line, section, text): the first ``n`` head lines of each file, numbered from 0: what a report has, without reading its records."""
    h = df.select("file", "line", F.trim("text").alias("text"), _head().alias("section")).filter("section is not null")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return h.withColumn("head", (rank - 1).cast("bigint")).filter(F.col("head") < n).select("file", "head", "line", "section", "text")


def _head() -> Column:
    head = F.lit(None).cast("string")
    for word, name in SECTIONS.items():
        head = F.when(F.lower("text").contains(word), name).otherwise(head)
    return head


def sections(df: DataFrame) -> DataFrame:
    """rows with the section whose head line came last in the file, and whether they are head lines."""
    latest = lambda c: F.last(c, ignorenulls=True)
    df = _carried(df.withColumn("_h", _head()), latest(F.col("_h")), F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("line"))), latest, lambda before, within: F.coalesce(within, before), "section")
    return df.withColumn("is_head", F.col("_h").isNotNull()).drop("_h")


def records(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(file, section, id, values): of each id the last record with the section's number of values; others are skipped.

    Reactions have 4 numbers, tensors 8 (element, point, six components). ``ids`` (section, id) keeps only those.
    """
    r = numbers(sections(df)).filter("section is not null and not is_head")
    fits = ((F.col("section") == "reaction") & (F.size("numbers") == 4)) | ((F.col("section") != "reaction") & (F.size("numbers") == 8))
    skip = F.when(F.col("section") == "reaction", 2).otherwise(3)
    r = r.filter(fits).select("file", "section", "line", F.get("numbers", F.lit(0)).cast("bigint").alias("id"), F.slice("numbers", skip, F.size("numbers")).alias("values"))
    if ids is not None:
        r = r.join(ids, ["section", "id"], "left_semi")
    return r.groupBy("file", "section", "id").agg(F.max_by("values", "line").alias("values"))


def id_set(df: DataFrame, keyword: str, name: str) -> DataFrame:
    """(file, id): the ids of the first block of a deck with this keyword and name."""
    head = F.startswith(F.trim("text"), F.lit("*"))
    heads = F.sum(F.col("_head").cast("int"))
    df = _carried(df.withColumn("_head", head), heads, heads, F.sum, lambda before, within: within + F.coalesce(before, F.lit(0)), "block")
    wanted = F.upper(F.regexp_replace("text", r"\s", ""))
    named = df.filter("_head").filter(wanted.startswith(f"*{keyword.upper()}") & wanted.rlike(rf"=({name.upper()})(,|$)")).groupBy("file").agg(F.min("block").alias("block"))
    rows = df.filter("not _head").join(named, ["file", "block"], "left_semi")
    return rows.select("file", F.explode(F.split("text", ",")).alias("x")).select("file", F.expr("try_cast(trim(x) as bigint)").alias("id")).filter("id is not null")


def deck_set(ids: DataFrame, keyword: str, name: str, per_line: int = 16) -> DataFrame:
    """(line, text) of a deck's id set: ids (from 0) counted from 1, ``per_line`` on each line, in order."""
    r = positioned(ids.select("id"), [], [F.col("id")], "_r")
    body = r.groupBy((F.floor(F.col("_r") / per_line) + 1).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: (x + 1).cast("string")), ", ").alias("text"))
    return ids.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line"), F.lit(f"*{keyword.upper()}, {keyword.upper()}={name}").alias("text")).union(body)


def deck(points: DataFrame, tets: DataFrame, node_sets: dict[str, DataFrame], element_sets: dict[str, DataFrame], modulus: float, ratio: float, displacement: float) -> DataFrame:
    """(block, line, text) of a whole solver deck: nodes, elements, sets, material and one static step; ids (from 0) counted from 1.

    ``points``: nid, x, y, z; ``tets``: eid, n0 to n3; sets: tables of id. ``block`` and ``line`` order the text
    (``sinks.ordered_text`` writes it). The sets named TOP, BOTTOM, ANCHOR_A and ANCHOR_B carry the boundary conditions.
    """
    spark = points.sparkSession
    said = lambda block, *lines: spark.createDataFrame([(block, -len(lines) + k, x) for k, x in enumerate(lines)], "block int, line bigint, text string")
    one = lambda *cs: F.concat_ws(",", *[c.cast("string") for c in cs])
    parts = [
        said(0, "*HEADING", "static compression", "*NODE"),
        points.select(F.lit(0).alias("block"), F.col("nid").cast("bigint").alias("line"), one(F.col("nid") + 1, F.col("x"), F.col("y"), F.col("z")).alias("text")),
        said(1, "*ELEMENT,TYPE=C3D4,ELSET=SOLID"),
        tets.select(F.lit(1).alias("block"), F.col("eid").cast("bigint").alias("line"), one(*[F.col(c) + 1 for c in ("eid", "n0", "n1", "n2", "n3")]).alias("text")),
    ]
    block = 2
    for keyword, sets in (("NSET", node_sets), ("ELSET", element_sets)):
        for name, ids in sets.items():
            parts.append(deck_set(ids, keyword, name).select(F.lit(block).alias("block"), "line", "text"))
            block += 1
    parts.append(said(
        block, "*MATERIAL,NAME=TI64", "*ELASTIC", f"{modulus},{ratio}", "*SOLID SECTION,ELSET=SOLID,MATERIAL=TI64", "*STEP", "*STATIC", "*BOUNDARY", "BOTTOM,3,3,0.", f"TOP,3,3,{displacement}",
        "ANCHOR_A,1,2,0.", "ANCHOR_B,2,2,0.", "*NODE PRINT,NSET=TOP", "RF", "*EL PRINT,ELSET=TARGETS", "S", "E", "*END STEP",
    ))
    return reduce(DataFrame.union, parts)
