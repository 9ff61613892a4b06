"""Names and shelves compared as matrices: one row per name and shelf, best of all pairs, smallest id on ties."""
import random

import pytest

from cohort_gaps.operators import joins


@pytest.mark.parametrize("matrix,hot", [(1, 4096), (1, 0), (1024, 4096)])
def test_matrices_find_the_best_name(spark, monkeypatch, matrix, hot):
    monkeypatch.setattr(joins, "MATRIX", matrix)
    monkeypatch.setattr(joins, "HOT_LISTS", hot)
    monkeypatch.setattr(joins, "FEW", 1)
    monkeypatch.setattr(joins, "SHELF", 16)
    monkeypatch.setattr(joins, "ASKED", 8)
    called, original = [], joins._best_of_crowded
    monkeypatch.setattr(joins, "_best_of_crowded", lambda *a: called.append(1) or original(*a))
    rng = random.Random(11)
    words = [f"w{i}" for i in range(20)]
    names = [(i, "AB"[i % 2], " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(260)]
    asked, held = names[:100], names[100:]
    found = {r["unit_id"]: (r["match_id"], r["similarity"]) for r in joins.best_name_match(
        spark.createDataFrame(asked, "unit_id long, result_postcode string, result_name string"),
        spark.createDataFrame(held, "unit_id long, postcode string, unit_name string"), []).collect()}
    for i, block, name in asked:
        own = set(name.split())
        best = max((len(own & set(o.split())) / len(own | set(o.split())), -j) for j, b, o in held if b == block)
        assert found[i] == (-best[1], best[0])
    assert called and hasattr(joins, "_compare")
