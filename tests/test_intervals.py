"""Closed and opened units in hot blocks: the same groups and counts as all pairs give, in rows that grow with the units."""
import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohort_gaps.operators import intervals
from cohort_gaps.operators.components import connected_components, local_roots

SCHEMA = "unit_id long, postcode string, unit_name string, close_date date, open_date date"
DAY = dt.date(2020, 1, 1)


def hot_block(n, seed, vocabulary, days=400, size=3):
    """One block, one word that all names have, and a vocabulary of the others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["common", *rng.sample(vocabulary, rng.randint(1, size))]
        closes = DAY + dt.timedelta(rng.randint(0, days)) if rng.random() < 0.7 else None
        opens = DAY + dt.timedelta(rng.randint(0, days)) if rng.random() < 0.7 else None
        rows.append((i, "A", " ".join(words), closes, opens))
    return rows


def true_pairs(rows, gap, least):
    vocabulary = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[2].split()}))}
    has = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        has[i, [vocabulary[w] for w in r[2].split()]] = 1
    shared, size = has @ has.T, has.sum(1)
    alike = shared / (size[:, None] + size[None] - shared) >= least - 1e-12
    end = np.array([np.nan if r[3] is None else r[3].toordinal() for r in rows])
    start = np.array([np.nan if r[4] is None else r[4].toordinal() for r in rows])
    block = np.array([hash(r[1]) for r in rows])
    near = (np.abs(end[:, None] - start[None]) <= gap) & (block[:, None] == block[None]) & alike
    np.fill_diagonal(near, False)
    return near


def groups(a, b):
    nodes, roots = local_roots(np.asarray(a, np.int64), np.asarray(b, np.int64))
    return dict(zip(nodes.tolist(), roots.tolist()))


@pytest.mark.parametrize("cell,light,gap,least", [(8, 1, 60, 0.5), (3, 0, 10, 0.5), (16, 2, 400, 0.34), (4, 1, 0, 0.8),
                                                  (256, 64, 60, 0.5)])
def test_cells_give_the_same_groups_and_counts(spark, monkeypatch, cell, light, gap, least):
    monkeypatch.setattr(intervals, "CELL", cell)
    monkeypatch.setattr(intervals, "LIGHT", light)
    monkeypatch.setattr(intervals, "COLUMNS", 5)
    rows = hot_block(150, cell, [f"w{i}" for i in range(9)])
    # The same name on the same days, in another block too.
    rows += [(1000 + i, "AB"[i % 2], "twin hall", DAY, DAY + dt.timedelta(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    near = true_pairs(rows, gap, least)
    ids = np.array([r[0] for r in rows])
    at, to = np.nonzero(near)

    edges = intervals.interval_similarity_edges(df, gap, least).collect()
    found = groups([e.unit for e in edges], [e.centre for e in edges])
    assert found == groups(ids[at], ids[to])

    after, before = Counter(ids[at].tolist()), Counter(ids[to].tolist())
    counted = {r.unit: (r.n_after, r.n_before) for r in intervals.interval_partners(df, gap, least).collect()}
    assert counted == {i: (after[i], before[i]) for i in {*after, *before}}


def test_twenty_thousand_names_with_one_word_in_common_stay_linear(spark, monkeypatch):
    """All pairs of a block of 20,000 units would be 10^8, and nearly two millions of them are similar."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(210)]
    rows = [(i, "A", " ".join(["common", *rng.sample(vocabulary, 2)]), DAY if i % 2 else None, None if i % 2 else DAY)
            for i in range(20_000)]
    stored, original = [], intervals.cut_lineage

    def counted(table):
        out = original(table)
        stored.append(out.count())
        return out

    monkeypatch.setattr(intervals, "cut_lineage", counted)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    edges = intervals.interval_similarity_edges(df)
    near = true_pairs(rows, 60, 0.5)
    assert near.sum() > 1_500_000
    # A unit stands under at most three words, three runs of days and two sizes of a partner.
    assert max(stored) < 20 * len(rows) and edges.count() < 10 * len(rows)
    expected = groups(*np.nonzero(near))
    found = {r.node: r.component for r in connected_components(edges, "unit", "centre", smallest=True).collect()}
    assert found == expected


def test_one_word_shared_by_names_that_are_not_alike(spark, monkeypatch):
    """Groups that stay apart under a hot word are compared cell by cell and give no rows."""
    monkeypatch.setattr(intervals, "CELL", 16)
    monkeypatch.setattr(intervals, "LIGHT", 1)
    rows = [(i, "A", f"common park x{i % 40} y{i % 40} z{i % 40}", DAY if i % 2 else None,
             None if i % 2 else DAY + dt.timedelta(7 * (i % 3))) for i in range(400)]
    near = true_pairs(rows, 60, 0.9)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = intervals.interval_similarity_edges(df, min_similarity=0.9).collect()
    assert groups([e.unit for e in edges], [e.centre for e in edges]) == groups(*np.nonzero(near))


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert intervals.interval_similarity_edges(empty).count() == intervals.interval_partners(empty).count() == 0
    rows = [(1, None, "hill", DAY, None), (2, None, "hill", None, DAY), (3, "A", None, DAY, None), (4, "A", "the", None, DAY),
            (5, "A", "hill", DAY, DAY), (6, "A", "hill", None, DAY), (6, "A", "hill", None, DAY)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(e) for e in intervals.interval_similarity_edges(df).collect()} == {(5, 6)}
    with pytest.raises(ValueError):
        intervals.interval_similarity_edges(df, min_similarity=0.0)


def test_shared_values_of_lists():
    left = pa.array([[1, 2, 3], [], [7]], pa.list_(pa.int64()))
    right = pa.array([[9], [3, 1], [7, 2], []], pa.list_(pa.int64())).slice(1, 2)
    assert intervals.shared_values(left, right).tolist() == [[2, 1], [0, 0], [0, 1]]
