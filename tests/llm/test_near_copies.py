"""Near copies of the pipeline are found by fingerprints (general pigeonhole), and by what goes beyond them."""

import numpy as np

from meshwright.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stage_compares_what_fingerprints_link(spark, sf, monkeypatch):
    import corpus_pipeline as cp

    banded = simhash._banded

    def alone(batches, shingle):
        import pyarrow as pa

        for b in banded(batches, shingle):  # each text in a bucket of its own: fingerprints alone bring near copies together
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[x] for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], b.schema.names)

    monkeypatch.setattr(simhash, "_banded", alone)
    base = [f"w{k}" for k in np.random.default_rng(3).integers(0, 5000, 900)]
    bits = lambda w: bin((simhash.simhash(" ".join(base).encode())[0] ^ simhash.simhash(" ".join(w).encode())[0]) & (1 << 64) - 1).count("1")
    near = next(w for n in range(1, 60) if 0 < bits(w := [*base[:-n], "end"]) <= 2)
    d = spark.createDataFrame([(k, " ".join(w), None, None, None) for k, w in enumerate((base, near, [f"x{k}" for k in range(200)]))], SCHEMA)
    assert sorted(r["doc_id"] for r in cp.near_dedup_stage(spark, d, sf).collect()) == [0, 2]
