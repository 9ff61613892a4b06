"""The near-dedup stage takes links of near fingerprints and of shared shingles together."""
import numpy as np

import corpus_pipeline
from cohort_gaps.llm import simhash


def test_stage_links_by_fingerprints_and_by_shingles(spark, monkeypatch, sf_dir):
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(500)]
    base = list(rng.choice(vocabulary, 160))
    shared = [*base[:80], "other", *base[81:]]
    # A passage of a few words said over and over outvotes 24 words of one's own: same fingerprint, other five-word shingles.
    chant = "so say we all of us here "
    rows = [(1, " ".join(base)), (2, " ".join(shared)), (7, " ".join(rng.choice(vocabulary, 160))),
            (4, chant * 60 + " ".join(vocabulary[:24])), (5, chant * 60 + " ".join(vocabulary[100:124])), (9, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")
    prints = {i: simhash.fingerprint(t) & ((1 << 64) - 1) for i, t in rows}
    assert (prints[4] ^ prints[5]).bit_count() <= 2 < (prints[1] ^ prints[2]).bit_count()
    # Shingles alone keep both 4 and 5, fingerprints alone both 1 and 2.
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 4, 5, 7, 9]
    kept = corpus_pipeline.keep_one_copy(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 9] and kept.columns == docs.columns
