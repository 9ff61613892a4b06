"""Buckets of the line dedup as arrays, and exact counts of shingles as numbers."""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohort_gaps.llm import line_dedup


@pytest.mark.parametrize("kind", ["array<long>", "binary"])
def test_bucket_members_are_all_lines_of_shared_bands(spark, monkeypatch, tmp_path, kind):
    """Many portions and groups, a bucket far above DENSE, repeated rows, and lines without bands."""
    monkeypatch.setattr(line_dedup, "PORTION", 400)
    monkeypatch.setattr(line_dedup, "GROUP_LINES", 60)
    rng = np.random.default_rng(21)
    common = int(rng.integers(-2 ** 63, 2 ** 63))
    few = rng.integers(-2 ** 63, 2 ** 63, 300).tolist()
    rows = [(i, [common] * (i % 2) + rng.choice(few, 2, replace=False).tolist() + [int(rng.integers(-2 ** 63, 2 ** 63))])
            for i in range(-300, 300)]
    rows += rows[:200] + [(900, [])]
    buckets = defaultdict(set)
    for i, bands in rows:
        for band in bands:
            buckets[band].add(i)
    assert len(buckets[common]) == 300 > 4 * line_dedup.DENSE
    if kind == "binary":
        rows = [(i, np.array(bands, np.int64).tobytes()) for i, bands in rows]
    path = f"{tmp_path}/signed.parquet"
    spark.createDataFrame(rows, f"id long, bands {kind}").write.parquet(path)
    found = [tuple(r) for r in line_dedup.bucket_members(spark.read.parquet(path)).select("band", "id", "first").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(b, i, min(ids)) for b, ids in buckets.items() if len(ids) > 1 for i in ids}


def test_a_portion_is_a_row_per_range_and_few_rows_of_a_bucket():
    rng = np.random.default_rng(22)
    band = np.concatenate((rng.integers(0, 2 ** 64, 50_000, np.uint64), np.full(9_000, 77, np.uint64)))
    ids = np.arange(len(band))
    dealt = line_dedup._dealt(band, ids, 16)
    parts = dealt.column("part").to_pylist()
    assert parts[:-1] == list(range(16)) and parts[-1] >= 16
    rows = [list(zip(np.frombuffer(b, np.uint64).tolist(), np.frombuffer(i, np.int64).tolist()))
            for b, i in zip(dealt.column("bands").to_pylist(), dealt.column("ids").to_pylist())]
    assert sum(b == 77 for b, _ in rows[0]) == 2 and sorted(rows[-1]) == [(77, i) for i in range(50_000, 59_000)]
    assert sorted(x for r in rows[:-1] for x in r if x[0] != 77) == sorted(zip(band[:50_000].tolist(), range(50_000)))


def test_packed_shingles_stand_for_shingles():
    rng = np.random.default_rng(23)
    lines = ["".join(rng.choice(list("ab\u00e9\u0ffd"), rng.integers(1, 12))) for _ in range(400)]
    packed = line_dedup.packed_shingles(pa.array(lines))
    for x, y, line, other in zip(packed, packed[1:], lines, lines[1:]):
        both = line_dedup.character_shingles(line) & line_dedup.character_shingles(other)
        assert len(x) == len(line_dedup.character_shingles(line)) and len(np.intersect1d(x, y)) == len(both)
    assert line_dedup.packed_shingles(pa.array(["abcdef\u4e2d", "abcdef"]))[0] is None


def test_pairs_are_counted_exactly_with_any_characters(spark):
    rng = np.random.default_rng(24)
    lines = ["".join(rng.choice(list("abcdefgh\u4e2d"[:8 + k % 2]), rng.integers(2, 60))) for k in range(60)]
    pairs = [(i, j, a, b[:-1] + a[len(b) - 1:]) for i, a in enumerate(lines) for j, b in enumerate((a, a + "q", a[3:] + "xy"))]
    got = {tuple(r) for r in line_dedup.jaccard_pairs(
        spark.createDataFrame(pairs, "a long, b long, line_a string, line_b string")).collect()}
    sets = {(i, j): (line_dedup.character_shingles(a), line_dedup.character_shingles(b)) for i, j, a, b in pairs}
    assert got == {k for k, (x, y) in sets.items() if len(x & y) >= 0.8 * len(x | y) - 1e-9}
