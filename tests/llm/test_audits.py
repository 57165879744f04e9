"""Source divergence, licence scans and whitening against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import divergence, licenses, whitening

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, count int, at int, p int, key int, labels string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS)


def divergent(rows, least=10, top=10):
    """The contract, term by term."""
    held = defaultdict(list)
    for _, text, lang, source in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        held[lang or "", source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
    out = set()
    for lang in {k for k, _ in held}:
        groups = {s: Counter(w for t in texts for w in t) for (k, s), texts in held.items() if k == lang}
        docs_of = Counter(w for (k, _), texts in held.items() if k == lang for t in texts for w in set(t))
        kept = [w for w, n in docs_of.items() if n >= least]
        every = sum(groups.values(), Counter())
        size = {s: sum(c[w] for w in kept) for s, c in groups.items()} | {None: sum(every[w] for w in kept)}
        p = lambda c, s, w: 1 + 10**9 * (c[w] + 2) // (size[s] + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = {o: sum(f(p(c, s, w), p(d, o, w)) for w in kept) for o, d in groups.items() if o != s}
            terms = {w: f(p(c, s, w), p(every, None, w)) for w in kept if c[w] and p(c, s, w) > p(every, None, w)}
            for part, values in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("block, postings", [(256, 64), (3, 2)])
def test_divergence(spark, monkeypatch, block, postings):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "TILE", 4)
    rng = random.Random(5)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)] + ["É", "éB", "Zz"]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (1 + i) for i in range(63)], k=rng.randint(0, 30))) + (" rare" + "xyz"[k % 3] if k % 9 == 0 else ""), rng.choice(["en", "en", "fr", None]), f"s{min(rng.randint(0, 14), rng.randint(0, 14))}") for k in range(400)]
    rows += [(1, None, "de", "a"), (1, "", "de", None), (None, "only 1 2", "de", "b"), (2, "same " * 50, "fr", "s1"), (2, "same " * 50, "fr", "s1")] + [(9, "same", "fr", f"t{k}") for k in range(9)]
    got = divergence.audit(docs(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == divergent(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0


def test_share_is_exact(spark):
    rng = random.Random(1)
    rows = [(n := rng.randint(0, 10**k), rng.randint(0, n), rng.randint(1, 10**6)) for k in range(1, 16) for _ in range(20)]
    df = spark.createDataFrame(rows, "n bigint, c bigint, v bigint")
    for r in df.select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["v"])


def test_task_counts_pass_on_what_they_hold(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD", 5)
    rows = [("en", "s", f"{'abcdefgh'[k % 8]} a A") for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 4], strict=True)], ["lang", "source", "text"]) for k in range(0, 40, 4)]
    got, docs_of = Counter(), Counter()
    for b in divergence._counted(iter(batches)):
        for r in b.to_pylist():
            got[r["term"]] += r["count"]
            docs_of[r["term"]] += r["docs"]
    assert got["a"] == 85 and docs_of["a"] == 40 and got["b"] == docs_of["b"] == 5


def plain_matches(words, templates):
    """At each word, the longest run ending there that a template holds, by trying every one."""
    held = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    out = {}
    for at in range(len(words)):
        for length in range(at + 1, 0, -1):
            if tuple(words[at - length + 1 : at + 1]) in held:
                out[at] = length
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: 2 + seed % 3]
    templates = [rng.choices(letters, k=rng.randint(1, 25)) for _ in range(5)]
    a = licenses.Automaton(templates)
    for _ in range(30):
        words = rng.choices([*letters, b"?"], weights=[*[8] * len(letters), 1], k=rng.randint(0, 60))
        got = {at: (state, length) for at, state, length in a.stream(words)}
        assert {at: n for at, (_, n) in got.items()} == plain_matches(words, templates)
        for at, (state, n) in got.items():
            run = words[at - n + 1 : at + 1]
            assert a.ends[state] == {k: e for k, t in enumerate(templates) if (e := [j for j in range(n - 1, len(t)) if t[j - n + 1 : j + 1] == run])}
    assert len(a.size) <= 2 * sum(map(len, templates)) + 1


def based(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))


TEXTS = [
    None, "", "!!", "MIT License", "the mit licensed", "CC-BY-NC 4.0 cc by", "Apache-License, GNU General Public Licence", "x GNU GENERAL PUBLIC LICENSE gnu general public license", "gnu gnu general public license mit mit license",
    "é mit license İ", "MIT\tLicense\nMIT License", "general public license", "mit license " * 5000, "cc by" + " by cc by" * 3, "word" * 50_000,
]


def test_base_phrases(spark, sf):
    rows = [(k, t, None, None) for k, t in enumerate(TEXTS)] + [(None, "mit license", "x", "y"), (3, "mit license", "x", "y")]
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = licenses.scan(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], *[r[c] for c in columns]) for r in got) == Counter((i, *based(t)) for i, t, _, _ in rows)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and (r["score"] == 1) == (r["n_base"] > 0) for r in got)
    real = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op12_license_scan(spark, sf).collect():
        assert tuple(r[c] for c in columns) == based(real[r["doc_id"]])
    assert licenses.scan(docs(spark, [])).count() == licenses.spans(docs(spark, [])).count() == 0


def test_spans_of_changed_notices(spark):
    mit = licenses.TEMPLATES[0][1].split()
    changed = mit[:40] + ["Copyright", "2020", "somebody"] + mit[40:90] + mit[95:]
    rows = [(1, "intro words " + " ".join(mit).upper() + " outro", None, None), (2, " ".join(changed), None, None), (3, " ".join(mit[:60]), None, None), (4, " ".join(mit[100:] + mit[:100]), None, None), (5, " ".join([*mit, *["x"] * 30, *mit]), None, None), (6, None, None, None)]
    got = defaultdict(list)
    for r in licenses.spans(docs(spark, rows)).collect():
        got[r["doc_id"]].append((r["label"], r["start"], r["end"], r["covered"]))
    n = len(mit)
    assert got[1] == [("mit", 2, n + 2, n)]
    assert got[2] == [("mit", 0, n - 2, n - 5)]
    assert 3 not in got and 4 not in got and 6 not in got
    assert sorted(got[5]) == [("mit", 0, n, n), ("mit", n + 30, 2 * n + 30, n)]
    scores = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert scores[1]["score"] == 1 and scores[1]["labels"] == "mit" and scores[1]["base_labels"] == ""
    assert math.isclose(scores[3]["score"], 60 / n) and scores[3]["labels"] == ""


VECTORS = "vec_id bigint, embedding array<float>, label int, key string, vector string, component int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], VECTORS)


def check_whitened(rows, got, k):
    """What the contract asks for, from a covariance of its own."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    assert len(got) == n * min(k, x.shape[1])
    deviation = Counter((i, int(d)) for (i, _), d in zip(rows, ((x * n - sums) ** 2).sum(axis=1), strict=True))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    for c in range(1, min(k, x.shape[1]) + 1):
        of = [r for r in got if r["component"] == c]
        assert {r["n"] for r in of} == {n}
        assert np.allclose([r["explained"] for r in of], values[c - 1] / values.sum(), rtol=1e-9)
        w = np.array([r["whitened"] for r in sorted(of, key=lambda r: r["vec_id"])])
        order = np.argsort([i for i, _ in rows], kind="stable")
        u = centred[order].T @ w / n / math.sqrt(values[c - 1])  # V u / e, as w = X u / sqrt(e)
        assert np.allclose(covariance @ u, values[c - 1] * u, atol=1e-8 * values[0]) and np.isclose(u @ u, 1, rtol=1e-9)
    return {r["identity_error"] for r in got}


def test_whitening(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    (off,) = check_whitened(rows, whitening.op13_embedding_whitening(spark, sf).collect(), 32)
    assert off <= 1e-4


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(v) for v in rng.normal(size=5) * [9, 4, 2, 1, 0.5]]) for k in range(60)] + [(60 + k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(20)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (None, None)]
    (off,) = check_whitened(good, whitening.whiten(vectors(spark, good + odd)).collect(), 32)
    assert off <= 1e-9
    twice = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [3.0, 2.0, 1.0])]
    got = whitening.whiten(vectors(spark, twice), components=2).collect()
    assert len(got) == 6 and {r["whitened"] for r in got if r["component"] == 2} == {None} and abs({r["explained"] for r in got if r["component"] == 1}.pop() - 1) < 1e-12
    for none in ([], odd[:2], [(1, [float("nan")])]):
        assert whitening.whiten(vectors(spark, none)).count() == 0
    alone = whitening.whiten(vectors(spark, [(7, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in alone] == [(1, 0, None, None)] * 2


def test_whitening_is_exact_beyond_longs(spark):
    rows = [(0, [3e15, 0.0]), (1, [-3e15, 1.0]), (2, [1e38, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert set(got) == {0, 1, 2} and got[0] is None  # more than a long holds


def test_texts_are_shuffled_once_for_both_passes(spark, sf):
    from meshwright.llm import substring

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = substring.judged(substring.numbered(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))).select("doc", "kept")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    assert re.search(r"ReusedExchange \[doc#\d+L?, text#", plan), plan
