"""Blocks of few units are joined as they are: no entries by words, and the same pairs and counts as all pairs give."""
import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest

from cohort_gaps.operators import intervals
from test_intervals import DAY, SCHEMA, groups, true_pairs


def rows_of_blocks(sizes, seed):
    rng = random.Random(seed)
    return [(1000 * b + i, f"B{b}", " ".join(rng.sample(["one", "two", "three", "four", "five"], rng.randint(1, 4))),
             DAY + dt.timedelta(rng.randint(0, 300)) if rng.random() < 0.8 else None,
             DAY + dt.timedelta(rng.randint(0, 300)) if rng.random() < 0.8 else None)
            for b, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("few", [0, 3, 32])
def test_blocks_of_few_and_of_many_units(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    rows = rows_of_blocks([1, 2, 5, 12, 40, 120], 7)
    rows += [(9000 + i, "B3", "two one", rows[5][3], DAY) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    near, ids = true_pairs(rows, 60, 0.5), np.array([r[0] for r in rows])
    at, to = np.nonzero(near)
    edges = intervals.interval_similarity_edges(df).collect()
    assert groups([e.unit for e in edges], [e.centre for e in edges]) == groups(ids[at], ids[to])
    after, before = Counter(ids[at].tolist()), Counter(ids[to].tolist())
    counted = {r.unit: (r.n_after, r.n_before) for r in intervals.interval_partners(df).collect()}
    assert counted == {i: (after[i], before[i]) for i in {*after, *before}}


def test_small_blocks_write_one_row_per_member(spark, monkeypatch):
    """Entries by run, word and sizes were some thirty rows a unit."""
    rows = rows_of_blocks([10] * 40, 8)
    stored, original = [], intervals.cut_lineage

    def counted(table):
        out = original(table)
        stored.append(out.count())
        return out

    monkeypatch.setattr(intervals, "cut_lineage", counted)
    intervals.interval_partners(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(stored) <= 2 * len(rows)
