"""The training-data operators against brute force, and on odd tables."""

import gzip
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import ctw, decontaminate, langid, packing, quality, queries, simhash, substring, toxicity, urls, warc
from meshwright.llm.common import lower_ascii, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, doc string, n string, w array<int>, t int, unique int, h int, component_id int"
LONG = "the quick fox and a dog " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one"), (5, "é ñ ß 123"), (6, LONG), (7, LONG), (None, None)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], SCHEMA)


def sample(sf, n=200):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by 1 limit {n}").fetchall()


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_tables(spark, rows):
    d = docs(spark, rows)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the quick fox and a dog the quick fox")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, None), (None, 1)], "doc_id bigint, toxic int")
    for df in (quality.judged(d), simhash.near_duplicates(d), substring.dedup(d), packing.pack(d), langid.identify(d), toxicity.score(d, labels), ctw.score(d)):
        assert df.count() == len(rows)
    assert quality.kept(d).columns == d.columns
    assert {r["doc_id"] for r in decontaminate.contaminated(d, bench).collect()} == ({6, 7} if rows else set())
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, None), (2, "", ""), (None, "http://x.net/a", None), (3, "http://a.example.net/en/1?x", "<p>hi"), (3, "http://a.example.net/en/1?x", "<p>hi"), (4, "://", "x" * 100_000)], []], ids=["odd", "empty"])
def test_odd_pages(spark, rows):
    p = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, g int, verdict string")
    assert urls.judged(p).count() == len(rows)
    assert warc.derivatives(warc.responses(p)).count() == 2 * len(rows)


def test_words_and_case(spark):
    df = spark.createDataFrame([("  A B\tÀ\x0bc ",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["A B", "À", "c"]
    assert df.select(lower_ascii(F.col("t"))).first()[0] == "  a b\tÀ\x0bc "


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_quality_counts(spark):
    text = "a b c d\nx\na b c d\n\n  \nx\n# $5"
    r = quality.signals(docs(spark, [(1, text)])).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (12, 13, 2, 2, 10)


def brute_simhash(text, shingle):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [1, 16])
def test_simhash_groups_equal_brute_force(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = [(i, t) for i, t, _ in sample(sf, 120)]
    rows += [(1000 + i, t.replace(" the ", f" x{i} ", 1)) for i, (_, t) in enumerate(rows[:60])] + [(2000, None), (2001, " ")]
    fp = {i: brute_simhash(t, 3) for i, t in rows}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            low = min(root[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2)
            if low < root[a]:
                root[a], changed = low, True
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fp
    assert {r["doc_id"]: r["component_id"] for r in got} == root


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_near_duplicates_of_a_similarity(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for changed in (0, 1, 3, 40):
            words = list(base)
            for at in rng.sample(range(300), changed):
                words[at] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "one two"), (902, "one two"), (903, "One Two")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), shingle=(1, 2), bits=2, count=12, similarity=0.8).collect()}
    want = {None: 0, 900: 900, 901: 900, 902: 902, 903: 902}
    for i in range(0, 48, 4):  # 3 changed words leave 285 of 311 shingles at least; 40 leave half of them at most
        want |= {i: i, i + 1: i, i + 2: i, i + 3: i + 3}
    assert got == want


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_of_clustered_edits(spark):
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(0, 240, 2):
        base = word(rng.randrange(80, 400))
        n = int(len(base) * rng.uniform(0.03, 0.17))
        at = rng.randrange(len(base) - n)
        copy = (base[:-n], base + word(n), base[:at] + word(n // 2) + base[at + n // 2 :])[k // 2 % 3]
        rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
        pairs.append((k, jaccard(*(t for _, t in rows[-2:]))))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), shingle=(1, 2), bits=2, count=12, similarity=0.8).collect()}
    assert sum(0.8 <= j < 0.85 for _, j in pairs) > 15
    assert {k: got[k + 1] for k, _ in pairs} == {k: k if j >= 0.8 else k + 1 for k, j in pairs}


def test_every_text_meets_its_bucket(spark, monkeypatch):
    # in one crowd, 1 was compared with all others and is like none of them; alike: numbers 5 apart at most
    crowd = [10, 15, 20, 40, 44, 90, 94, 98, 99]
    crowds = spark.createDataFrame([(7, n) for n in crowd] + [(8, 200), (8, 300)], "key bigint, node bigint").withColumns({"pos": F.lit(0), "size": F.lit(1)})
    none = spark.createDataFrame([], "root_x bigint, root_y bigint")
    for bucket in (64, 3):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = simhash._settled(crowds.select("node").distinct(), none, crowds, lambda e: e.filter("abs(x - y) <= 5").select("root_x", "root_y"), lambda x, y: F.lit(True))
        assert {r["node"]: r["root"] for r in got.collect()} == {10: 10, 15: 10, 20: 10, 40: 40, 44: 40, 90: 90, 94: 90, 98: 90, 99: 90, 200: 200, 300: 300}
    # each text like the next longer one only
    monkeypatch.setattr(simhash, "BUCKET", 1)
    monkeypatch.setattr(simhash, "CROWD", 1)
    rows = [(10 * g + k, " ".join(f"g{g}w{i}" for i in range(n))) for g in range(8) for k, n in enumerate((100, 86, 74, 63))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


@pytest.mark.parametrize("n", [100, 400])
def test_a_crowd_below_the_similarity_makes_no_pairs(spark, monkeypatch, n):
    rng = random.Random(2)
    shared = [f"s{k}" for k in range(300)]
    rows = [(k, " ".join(shared[:150] + [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([50, 55, 60]))] + shared[150:])) for k in range(n)]
    rows.append((n, rows[0][1] + " and more"))
    compared, whole = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda edges, sets, similarity: (compared.append(edges.count()), whole(edges, sets, similarity))[1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: i for i in range(n)} | {n: 0}
    assert 0 < sum(compared) <= 64 * n, compared


def test_postings_lose_no_similar_pair(spark):
    rng = random.Random(8)
    base = [rng.randrange(2000) for _ in range(120)]
    sets = {0: base}
    for k in range(1, 90):
        sets[k] = list({*rng.sample(base, rng.randrange(60, 121)), *(rng.randrange(2000) for _ in range(rng.randrange(40)))})
    table = spark.createDataFrame([(k, len(set(v)), sorted(set(v))) for k, v in sets.items()], "node bigint, size int, shingles array<int>")
    p = simhash.postings(table, 0.8)
    both = p.alias("a").join(p.alias("b"), "key").filter("a.node < b.node").select(*[F.struct(*[F.col(f"{e}.{c}") for c in ("node", "pos", "size")]).alias(e) for e in "ab"])
    got = {(r["a"]["node"], r["b"]["node"]) for r in both.filter(simhash.plausible(F.col("a"), F.col("b"), 0.8)).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert len(want) > 20 and want <= got and len(got) < 4005


@pytest.mark.parametrize("bits", [2, 4])
def test_links_lose_no_component(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 6)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    from meshwright.operators.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(0, f) for f in signed], "s int, fp bigint"), bits)).collect()}
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) % 2**64).bit_count() <= bits:
                assert got[a] == got[b]
    with pytest.raises(ValueError, match="bits"):
        simhash.links(spark.createDataFrame([(0, 1)], "s int, fp bigint"), 3)


def test_pigeonhole_thresholds_add_up():
    parts = simhash.allocate(10**6, np.full(64, 0.5), 2)
    assert sum(t + 1 for _, _, t in parts) == 3
    assert [p for p in simhash.allocate(10**10, np.full(64, 0.5), 2) if p[2] > 0]


def brute_substring(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    passage = [str(x) for x in rng.choice(vocab, 60)]
    rows = [(0, None), (1, ""), (2, "a " * 100)]
    for i in range(3, 60):
        w = [str(x) for x in rng.choice(vocab, int(rng.integers(1, 90)))]
        if i % 3 == 0:
            a = int(rng.integers(0, 40))
            w[5:5] = passage[a : a + int(rng.integers(15, 40))]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[10][1]), (101, rows[20][1] + " tail")]
    for batches in (1, 3):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs(spark, rows), batches).collect()}
        assert got == brute_substring(rows)


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_index_of_earlier_batches(spark, monkeypatch, broadcast):
    # batch after batch equals all at once, without earlier texts; runs are compacted on the way
    monkeypatch.setattr(substring, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[str(x) for x in rng.choice(vocab, 45)] for _ in range(6)]
    rows = []
    for i in range(75):
        w = [str(x) for x in rng.choice(vocab, int(rng.integers(1, 120)))]
        for p in rng.choice(6, int(rng.integers(0, 3))):
            at, size = int(rng.integers(0, 20)), int(rng.integers(19, 40))
            w[5:5] = passages[p][at : at + size]
        rows.append((i, " ".join(w)))
    rows[40] = (40, rows[3][1])
    index, got = substring.FingerprintIndex(spark, 3), {}
    for k in range(0, 75, 15):
        found = substring.dedup(docs(spark, rows[k : k + 15]), index=index)
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    assert got == brute_substring(rows)
    assert len(index.runs) == 2 and len(index.spent) == 4
    spent = [index.paths[x] for x in index.spent]
    index.clean()
    assert not any(os.path.exists(p) for p in spent) and index.merged().count() > 0
    # one document in history, one in the batch
    index = substring.FingerprintIndex(spark, 3)
    text = " ".join(passages[0])
    first = substring.dedup(docs(spark, [(1, text)]), index=index).collect()
    second = substring.dedup(docs(spark, [(2, "some words before " + text), (3, "nothing else")]), index=index).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in first] == [(1, 0)] and {r["doc_id"]: r["n_removed"] for r in second} == {2: 45, 3: 0}
    plan = index.seen(index.runs[-1])._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(fp" not in plan


def test_an_index_is_opened_by_another_session(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(60)]
    passage = [str(x) for x in rng.choice(vocab, 50)]
    rows = [(i, " ".join([str(x) for x in rng.choice(vocab, 30)] + passage[i % 7 : 30 + i % 9] + [str(x) for x in rng.choice(vocab, 9)])) for i in range(40)]
    digest = lambda found: {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    index, got = substring.FingerprintIndex(spark, 3), {}
    for k in (0, 10):
        got |= digest(substring.dedup(docs(spark, rows[k : k + 10]), index=index))
    index.store(str(tmp_path / "manifest"))
    got |= digest(substring.dedup(docs(spark, rows[20:30]), index=index))
    index.compact_all()
    assert len(index.runs) == len(index.digests) == len(index.texts) == 1
    index.store(str(tmp_path / "manifest"))
    index.clean()
    for name in (*index.runs, *index.texts):  # another catalog doesn't know them
        spark.sql(f"drop table {name}")
    other = spark.newSession()
    again = substring.FingerprintIndex.open(other, str(tmp_path / "manifest"))
    assert (again.batches, again.runs, again.digests, again.texts) == (3, index.runs, index.digests, index.texts)
    got |= digest(substring.dedup(docs(other, rows[30:]), index=again))
    assert got == brute_substring(rows)
    plan = again.seen(again.runs[-1])._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(fp" not in plan
    paths = [*again.paths.values(), *again.digests]
    again.drop()
    assert not any(os.path.exists(p) for p in paths)
    empty = substring.FingerprintIndex(spark, 2)
    empty.store(str(tmp_path / "empty"))
    assert substring.FingerprintIndex.open(spark, str(tmp_path / "empty")).runs == []


def test_reparameterised_question_is_caught(spark):
    bench = spark.createDataFrame([(1, "Anna buys 12 apples at 3 dollars each and then Anna sells 5 of them for what total profit")], "item_id bigint, text string")
    text = "intro words here Peter buys 40 apples at 7 dollars each and then {} sells 9 of them for what total profit end"
    got = {r["doc_id"]: r["n_changed"] for r in decontaminate.contaminated(docs(spark, [(1, text.format("Peter")), (2, text.format("Maria")), (3, "nothing of the kind is here at all today")]), bench).collect()}
    assert got[1] > 0 and 3 not in got
    whole = decontaminate.matches(docs(spark, [(2, text.format("Maria"))]), bench)
    assert whole.count() > 0 and 2 not in got  # one name cannot stand for two


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_documents_of_one_id_are_told_apart(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = ["Anna buys 12 apples at 3 dollars each and then Anna sells 5 of them for what profit", "in which year did the river flood the old town for the first time"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(None, items[0]), (1, items[0]), (1, items[1]), (None, items[1]), (2, items[0].replace("Anna", "Peter")), (2, items[0].replace("Anna buys", "Maria buys")), (2, items[0].replace("Anna", "Peter"))]
    got = [(r["doc_id"], r["item_id"], r["n_changed"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, 0), (1, 0, 0), (1, 1, 0), (None, 1, 0), (2, 0, 1)] + [x for x in got if x == (2, 0, 0)], key=str)


def test_copies_poor_in_literals_are_caught(spark):
    items = ["What is 12 + 34 * 5?", "Solve 3x + 7 = 22 for x.", "Who wrote Pride and Prejudice?", "NAME THE LARGEST PLANET OF OUR SYSTEM AND ITS MOONS", "in which year did the river flood the old town for the first time"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(k, f"some words before {t} and some behind") for k, t in enumerate(items)]
    rows += [(10, f"again {items[4].upper()} in capitals"), (11, "what is 13 + 34 * 5 and who wrote Emma and Persuasion"), (12, items[3].lower())]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(k, k) for k in range(5)} | {(10, 4), (12, 3)}


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_an_item_does_not_depend_on_others(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    words_ = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "eps", "zeta") for b in ("ro", "ta", "mi", "lu", "se", "no")]
    item = " ".join(words_)
    every = lambda n: " ".join(w.upper() if k % n == 0 else w for k, w in enumerate(words_))
    d = docs(spark, [(1, f"so {every(2)} and on"), (2, every(5)), (3, item.title()), (4, " ".join(words_[::-1]))])
    alone = [(7, item)]
    for bench in (alone, [*alone, (8, "one short item of nine words is not alike")], [(None, item)], [*alone, (7, "another text under the same number that nothing holds"), (7, item)]):
        got = decontaminate.contaminated(d, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
        assert sorted((r["doc_id"], r["item_id"] or 0, r["n_windows"]) for r in got) == [(k, bench[0][0] or 0, 29) for k in (1, 2, 3)]


@pytest.mark.parametrize("size", range(1, 9))
def test_windows_of_every_size(spark, size):
    rows = [(k, " ".join(t)) for k, t in enumerate((["a", "b", "a", "b", "a", "c", "d", "e", "f", "a", "b"], ["a"] * 8, ["x"] * (size - 1), ["a", "b", "a", "b", "a", "c", "d", "e", "f"]))]
    d = decontaminate._pieces(decontaminate.templates(docs(spark, rows), "doc_id"), ["doc_id"], {"t": {size}, "l": set()})
    got = {r["doc_id"]: r["h"] for r in d.select("doc_id", decontaminate._windows(size, "t").alias("h")).collect()}
    windows = {(k, i): tuple(t.split()[i : i + size]) for k, t in rows for i in range(len(t.split()) - size + 1)}
    hashes = {}
    for (k, i), w in windows.items():
        assert hashes.setdefault(w, got[k][i]) == got[k][i]
    assert len(set(hashes.values())) == len(hashes) and all(len(got[k]) == max(0, len(t.split()) - size + 1) for k, t in rows)


def test_buckets_are_optimal(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 30, 80)
    rows = [(i, "w " * int(k)) for i, k in enumerate(n)]
    got = packing.pack(docs(spark, rows), buckets=3, budget=64).collect()
    padding = sum(r["bucket_length"] - r["n_tokens"] for r in got)
    u = sorted(set(n.tolist()))
    best = min(sum(min(e for e in (a, b, u[-1]) if e >= k) - k for k in n) for a in u for b in u)
    assert padding == best
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch_id"]].append(r)
    for (k, _), rs in batches.items():
        per = max(1, 64 // rs[0]["bucket_length"])
        assert len(rs) <= per and sorted(r["slot"] for r in rs) == list(range(len(rs)))
    for k in {k for k, _ in batches}:
        assert sum(len(v) < max(1, 64 // v[0]["bucket_length"]) for (b, _), v in batches.items() if b == k) <= 1


def test_long_lengths_are_exact(spark):
    n = [3, 5, 4097, 4098, 4099, 5001, 5003, 9000]
    got = packing.pack(docs(spark, [(i, "w " * k) for i, k in enumerate(n)]), buckets=3).collect()
    best = min(sum(min(e for e in (a, b, max(n)) if e >= k) - k for k in n) for a in n for b in n)
    assert sum(r["bucket_length"] - r["n_tokens"] for r in got) == best and max(r["bucket_length"] for r in got) == 9000


def test_url_rules_and_model(spark):
    rows = [f"http://{h}{i}.example.net/en/{i}" for h in ("aa", "ab") for i in range(10)] + [f"http://zz{i}.example.com/de/{i}" for i in range(10)] + ["http://net/x", "http://sub.org/fr/1", "http://ORG/fr/", "http://org/FR/", "no scheme", "http://aa99.example.xyz/en/3", "http://zz99.example.xyz/de/3"]
    p = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], "page_id bigint, url string, html string")
    got = {rows[r["page_id"]]: r for r in urls.judged(p).collect()}
    assert got["http://aa1.example.net/en/1"]["rule"] == "example.net/en/" and got["http://aa1.example.net/en/1"]["verdict"] == "allow"
    assert got["http://net/x"]["verdict"] == "block" and got["http://ORG/fr/"]["rule"] == "org/fr/" and got["http://org/FR/"]["rule"] is None
    assert got["no scheme"]["host"] == got["no scheme"]["path"] == ""
    assert got["http://aa99.example.xyz/en/3"]["score"] > got["http://zz99.example.xyz/de/3"]["score"]
    # the model against a plain one
    learned = {u: got[u]["verdict"] for u in rows if got[u]["rule"]}
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    chars = {c for u in rows for c in u.lower()}
    for u, v in learned.items():
        s = "\x02" * urls.ORDER + u.lower()
        for i in range(urls.ORDER, len(s)):
            for k in range(urls.ORDER + 1):
                counts[v][s[i - k : i]][s[i]] += 1

    def probability(v, ctx, c):
        below = probability(v, ctx[1:], c) if ctx else 1 / len(chars)
        n = counts[v][ctx]
        return below if not n else (n[c] + len(n) * below) / (sum(n.values()) + len(n))

    for u in rows:
        s = "\x02" * urls.ORDER + u.lower()
        want = sum(math.log10(probability("allow", s[i - urls.ORDER : i], s[i]) / probability("block", s[i - urls.ORDER : i], s[i])) for i in range(urls.ORDER, len(s))) / len(u)
        assert got[u]["score"] == pytest.approx(want, abs=1e-9)


def test_ctw_base_and_normalisation(spark, sf):
    rows = [(i, t) for i, t, _ in sample(sf, 60)] + [(900, None), (901, "")]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in ctw.score(d).collect()}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"] for i, t in rows}
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    want = brute_ctw({i: low(t).encode() for i, t in rows}, {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10})
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(want[i], rel=1e-6)
        assert got[i]["bits_per_byte"] == pytest.approx(-want[i] * math.log2(10) / (len(low(t).encode()) + 1), rel=1e-6)


def brute_ctw(texts, training):
    """The frozen context tree by its definition: a node's weighted probability by recursion, a bit's by its whole path."""
    depth, counts = ctw.DEPTH, defaultdict(lambda: [0, 0])
    steps = lambda text: ((bytes(depth) + text)[i : i + depth] + bytes([c]) for i, c in enumerate(text + b"\0"))
    for i in training:
        for g in steps(texts[i]):
            for k in range(8):
                for d in range(depth + 1):
                    counts[g[depth - d : depth], (1 << k) | g[-1] >> (8 - k)][g[-1] >> (7 - k) & 1] += 1
    children = defaultdict(list)
    for ctx, bits in counts:
        if ctx:
            children[ctx[1:], bits].append((ctx, bits))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    log_w, share = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own, below = kt(*counts[node]), sum(log_w[c] for c in children[node])
        log_w[node] = own if len(node[0]) == depth else np.logaddexp(own, below) - math.log(2)
        share[node] = 1.0 if len(node[0]) == depth else math.exp(own - math.log(2) - log_w[node])
    known = {}

    def log10_gram(g):
        total = 0.0
        for k in range(8):
            p = None
            for d in range(depth, -1, -1):
                node = g[depth - d : depth], (1 << k) | g[-1] >> (8 - k)
                if node in counts:
                    n0, n1 = counts[node]
                    own = (n1 + 0.5) / (n0 + n1 + 1)
                    p = own if p is None else share[node] * own + (1 - share[node]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if g[-1] >> (7 - k) & 1 else 1 - p)
        return total

    out = {}
    for i, text in texts.items():
        out[i] = sum(known[g] if g in known else known.setdefault(g, log10_gram(g)) for g in steps(text))
    return out


def test_ctw_pieces_of_a_long_text(spark, monkeypatch):
    rows = [(k, "abc de fgh " * 3 * k) for k in range(1, 12)]
    want = {r["doc_id"]: r["score"] for r in ctw.score(docs(spark, rows)).collect()}
    monkeypatch.setattr(ctw, "_PIECE", 16)
    monkeypatch.setattr(ctw, "GROUP", 5)
    assert [g for p in ctw.grams(b"abcdefgh" * 9) for g in p.tolist()] == [int.from_bytes((bytes(5) + b"abcdefgh" * 9 + b"\0")[i : i + 6], "big") for i in range(73)]
    g = np.sort(np.unique(np.concatenate([p for _, t in rows for p in ctw.grams(t.encode())])))
    whole = ctw._parts(__import__("pandas").DataFrame({"g": g.astype(np.int64), "n": np.ones(len(g), np.int64)}))
    assert whole["g"].notna().sum() == len(g) and whole["key"].dropna().is_unique
    assert {r["doc_id"]: r["score"] for r in ctw.score(docs(spark, rows)).collect()} == pytest.approx(want)
    mix = np.array([np.frombuffer(x, np.float32) for x in whole["mix"].dropna()])
    assert not np.isnan(mix).any()


def test_ctw_weights_of_a_tiny_tree():
    n0, n1 = np.array([3.0]), np.array([1.0])
    want = math.log((0.5 * 1.5 * 2.5) * 0.5 / (1 * 2 * 3 * 4))
    assert ctw._log_kt(n0, n1)[0] == pytest.approx(want, abs=1e-9)


def test_language_held_out(spark, sf):
    r = langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([x["lang_pred"] == x["lang"] for x in r]) > 0.9
    assert {x["lang_pred"] for x in langid.identify(docs(spark, [(1, None), (2, "123 !"), (3, "")])).collect()} == {"und"}


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(360):
        w = [str(x) for x in rng.choice(vocab, 60)]
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(60))] = "horrid"
            w[int(rng.integers(60))] = "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    r = toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).filter("held_out").collect()
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in r)
    assert np.mean([x["predicted"] == (x["doc_id"] % 3 == 0) for x in r]) > 0.9


def test_toxicity_of_a_very_long_word(spark):
    begun = time.time()
    word, tri, start = toxicity._features([b"ab", b"x" * 3_000_000, b"<script>"])
    assert time.time() - begun < 10 and len(word) == len(start) == 3 and len(tri) == 3_000_000 + 2 + 8 + 3 * len(toxicity.HEADS)


def brute_toxicity(net, text):
    """The network's score of a text, step by step for each window."""
    rows = toxicity.tokens(text.encode())
    scores = []
    for a in range(0, max(1, len(rows) - toxicity.STRIDE), toxicity.STRIDE):
        e = [net.embed([w])[0] for w in rows[a : a + toxicity.WINDOW]]
        states = {}
        for s in "fb":
            h, out = np.zeros(toxicity.HIDDEN), []
            for x in e if s == "f" else e[::-1]:
                i, u, n = net.w[f"i{s}"], net.w[f"u{s}"], net.w[f"n{s}"]
                k = toxicity.HIDDEN
                z, r = (1 / (1 + np.exp(-(x @ i[:, at] + n[at] + h @ u[:, at]))) for at in (slice(0, k), slice(k, 2 * k)))
                c = np.tanh(x @ i[:, 2 * k :] + n[2 * k :] + (r * h) @ u[:, 2 * k :])
                h = (1 - z) * h + z * c
                out.append(h)
            states[s] = out if s == "f" else out[::-1]
        h = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
        weight = np.exp([np.tanh(x @ net.w["a"]) @ net.w["v"] for x in h])
        scores.append(float(sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True)) @ net.w["o"] + net.w["c"][0]))
    p = 1 / (1 + np.exp(-np.array(scores)))
    at, scale, w = net.calibration
    x = (np.array([np.log(p.mean() + 1e-3), np.clip(max(scores), -8, 8), np.log(len(scores))]) - at) / scale
    return 1 / (1 + np.exp(-(x @ w[:3] + w[3])))


def test_toxicity_equals_brute_force(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.train(d, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, labels).collect()}
    rows = [(i, t) for i, t, _ in sample(sf, 60) if t and t.split() and len(t) < 8000]
    assert len(rows) > 30
    for i, t in rows:
        assert got[i] == pytest.approx(brute_toxicity(net, t), abs=1e-4)


def brute_language(net, text):
    """A text's languages and their probabilities: filters slid over its windows one place at a time."""
    x, width = text.encode().lower(), langid.WINDOW
    step = width - max(langid.WIDTHS) + 1
    total = np.zeros(len(net.labels))
    for a in range(0, max(1, len(x) - max(langid.WIDTHS) + 1), step):
        w = (x[a : a + width] + bytes(width))[:width]
        h = []
        for k in langid.WIDTHS:
            at = [sum(net.w["e"][w[i + j]] @ net.w[f"f{k}"][j] for j in range(k)) + net.w[f"b{k}"] for i in range(width - k + 1)]
            h.append(np.maximum(np.max(at, axis=0), 0))
        z = np.concatenate(h) @ net.w["o"] + net.w["c"]
        total += z - z.max() - np.log(np.exp(z - z.max()).sum())
    windows = len(range(0, max(1, len(x) - max(langid.WIDTHS) + 1), step))
    z = total / windows
    p = np.exp(z - z.max())
    return dict(zip(net.labels, p / p.sum(), strict=True))


def test_language_equals_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.train(d)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    rows = [(i, t) for i, t, _ in sample(sf, 60) if t and re.search("[a-zA-Z]", t) and len(t) < 2500]
    assert len(rows) > 15
    for i, t in rows:
        want = brute_language(net, t)
        assert got[i]["score"] == pytest.approx(max(want.values()), abs=1e-3) and want[got[i]["lang_pred"]] == pytest.approx(max(want.values()), abs=1e-3)


def test_gru_gradient():
    net = toxicity.BiGru()
    ws = [b"a", b"bc", b"def", b"ghij"]
    net.known = frozenset(ws)
    word, tri, start = toxicity._features(ws)
    feats = (net._own(ws, word), tri, start, np.diff(np.append(start, len(tri))))
    ids, y = np.array([toxicity.window_rows(np.array([1, 2, 3, 4, 2]))[0], toxicity.window_rows(np.array([4, 1]))[0]]), np.array([1.0, 0.0])

    def loss():
        table = np.concatenate((np.zeros((1, 6 * toxicity.HIDDEN)), net.project(ws).astype(float)))
        return np.mean(np.log1p(np.exp(-net.logits(ids, table) * (2 * y - 1))))

    g = net.gradient(ids, y, feats)
    for k, w in net.w.items():
        at = np.unravel_index(np.argmax(np.abs(g[k])), w.shape)
        old = w[at]
        w[at] = old + 0.02
        up = loss()
        w[at] = old - 0.02
        down = loss()
        w[at] = old
        assert g[k][at] == pytest.approx((up - down) / 0.04, rel=0.05, abs=1e-4)


def test_warc_round_trip(spark, sf, tmp_path):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    records = warc.derivatives(warc.responses(p))
    warc.write_warc(records, str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w") + "/part-*").collect()}
    source = {r["record_id"]: r for r in warc.responses(p).collect()}
    rows = records.collect()
    for r in rows:
        b = back[r["record_id"]]
        assert b["block"] == r["block"] and b["refers_to"] in source and b["payload_digest"] == source[b["refers_to"]]["payload_digest"]
        assert b["block_digest"] == "sha256:" + hashlib.sha256(b["block"].encode()).hexdigest() and b["content_length"] == len(b["block"].encode())
    # each record is a member of its own, which can be read from its first byte
    members = 0
    for path in (tmp_path / "w").glob("part-*"):
        left = path.read_bytes()
        while left:
            d = zlib.decompressobj(31)
            text, left = d.decompress(left), d.unused_data
            assert text == b"" or (text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n"))
            members += text != b""
    assert members == len(rows)


def test_warc_blocks_that_are_no_text(spark, tmp_path):
    block = bytes(range(256)) + "é".encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "b.gz").write_bytes(gzip.compress(head.encode() + block + b"\r\n\r\n") + gzip.compress(b"WARC/1.0\r\nContent-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n"))
    one, two = warc.read_warc(spark, str(tmp_path / "*.gz")).collect()
    assert bytes(one["content"]) == block and one["block"] is None and one["block_digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    assert two["block"] == "é" and bytes(two["content"]) == "é".encode()


def test_warc_of_another_version(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{0}>\r\nContent-Length: 5\r\n\r\nhell{0}\r\n\r\n"
    (tmp_path / "one.gz").write_bytes(gzip.compress("".join(record.format(k) for k in range(3)).encode()))
    (tmp_path / "each.gz").write_bytes(b"".join(gzip.compress(record.format(k).encode()) for k in range(3, 6)))
    got = warc.read_warc(spark, str(tmp_path / "*.gz")).collect()
    assert sorted((r["record_type"], r["record_id"], r["block"]) for r in got) == [("response", f"<urn:uuid:{k}>", f"hell{k}") for k in range(6)]


def brute_near(rows):
    """Each document's smallest doc_id reachable over pairs of a Jaccard similarity of 0.8 or more on 5-word shingles."""
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def brute_kept(rows):
    """What is left of each text without the windows that start earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline as cp

    d, c = spark.read.parquet(f"{sf}/documents.parquet"), duckdb.connect()
    c.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")

    def run(k, before):
        after = cp.STAGES[k][1](spark, before, sf)
        after.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{k}-{time.time()}")
        after = spark.read.parquet(path)
        assert k == 4 or after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return after

    def sql(query, frame):
        c.register("documents", frame.toPandas())
        return c.sql(query).fetchall()

    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}
    whole = texts(d)
    one = run(0, d)
    rel = sql(f"select doc_id from ({queries.oracle_sql()['op5_quality_rules']}) where kept", d)
    assert texts(one) == {i: whole[i] for (i,) in rel}
    two = run(1, one)
    root = brute_near([(i, t) for i, t in texts(one).items()])
    assert texts(two) == {i: t for i, t in texts(one).items() if root[i] == i} and len(texts(two)) < len(texts(one))
    three = run(2, two)
    assert texts(three) == {i: t for i, t in brute_kept(list(texts(two).items())).items() if t}
    four = run(3, three)
    found = {r[0] for r in sql(f"select doc_id from ({queries.oracle_sql()['op1_decontaminate']})", three)}
    assert texts(four) == {i: t for i, t in texts(three).items() if i not in found}
    rows = run(4, four).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.split()) for i, t in texts(four).items()}
    n = sorted(len(t.split()) for t in texts(four).values())
    best = {0: 0}  # the least padding of the first j lengths, bucket by bucket
    for _ in range(packing.BUCKETS):
        best = {j: min(best[i] + sum(n[j - 1] - x for x in n[i:j]) for i in best if i <= j) for j in range(len(n) + 1)}
    assert sum(r["bucket_length"] - r["n_tokens"] for r in rows) == best[len(n)]


def test_pipeline_of_odd_tables(spark, sf):
    import corpus_pipeline as cp

    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES:
        assert stage(spark, odd, sf).count() <= len(ODD)
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_documents_without_an_id_of_their_own(spark, sf):
    import corpus_pipeline as cp

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 200").first()["text"]
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (8, leak), (8, text["e"]), (None, leak + " more"), (9, text["f"]), (9, text["f"])]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = cp.near_dedup_stage(spark, d, sf)
    assert sorted(r["text"] for r in got.collect()) == sorted([*text.values(), leak])
    got = cp.decontamination_stage(spark, cp.substring_stage(spark, got, sf), sf)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (8, text["e"]), (9, text["f"])], key=str)
    # copies without an id are removed, whatever their places
    assert sorted(r["n_removed"] for r in substring.dedup(docs(spark, [(None, text["a"]), (None, text["a"]), (None, text["a"] + " end"), (3, text["b"])])).collect()) == [0, 0, 60, 60]


def test_pipeline_passes_any_columns_on(spark, sf):
    import corpus_pipeline as cp

    names = ["_key", "_first", "_content", "_doc", "_kept", "_nth", "_own", "row", "key", "doc", "kept", "first", "content", "node", "root", "text_", "a.b"]
    text = {k: " ".join(f"{k}{i}x" for i in range(60)) for k in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (None, text["b"]), (3, text["c"]), (3, text["b"] + " tail")]
    d = spark.createDataFrame([(i, t, None, "s", None, *[f"{k}-{n}" for n in names]) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in cp.STAGES[1:4]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
    got = {r["text"]: r for r in d.collect()}
    assert set(got) == {text["a"], text["c"], "tail"} | ({text["b"]} if text["b"] in got else set())
    for t, r in got.items():
        assert len({r[n].split("-")[0] for n in names}) == 1 and all(r[n].endswith(f"-{n}") for n in names), t
