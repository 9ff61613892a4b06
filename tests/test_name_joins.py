"""Names, ids and shelves are never sent to every task through the driver, whatever Spark takes their size for."""
import random

import pytest

from cohort_gaps.operators import joins

# Columns of the tables of blocks and words, which are counted before they are sent, and of hot words.
COUNTED = {"block", "word", "n", "n_block", "first_id", "own", "n_own"}


def sent_columns(node):
    """Columns of the tables that a plan sends to every task."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return sent_columns(node.initialPlan())
    found = set()
    if node.nodeName() == "BroadcastExchange":
        found = {node.output().apply(i).name() for i in range(node.output().size())}
    return found.union(*(sent_columns(node.children().apply(i)) for i in range(node.children().size())))


@pytest.mark.parametrize("sent", [0, 100_000])
def test_no_name_goes_through_the_driver(spark, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT", sent, raising=False)
    monkeypatch.setattr(joins, "FEW", 8)
    monkeypatch.setattr(joins, "HOT_LISTS", 200)
    monkeypatch.setattr(joins, "ASKED", 8)
    plans, original = [], joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan()) or original(df))
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    # Two crowded blocks and one of few.
    names = [(i, "C" if i % 20 == 0 else "AB"[i % 2], " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(400)]
    asked, held = names[:160], names[160:]
    out = joins.best_name_match(
        spark.createDataFrame(asked, "unit_id long, result_postcode string, result_name string"),
        spark.createDataFrame([(*r, r[0] / 2) for r in held], "unit_id long, postcode string, unit_name string, place double"),
        ["place"])
    plans.append(out._jdf.queryExecution().executedPlan())
    columns = set().union(*map(sent_columns, plans))
    assert columns <= COUNTED and ("n_block" in columns) == (sent > 0)
    found = {r["unit_id"]: (r["match_id"], r["similarity"], r["place"]) for r in out.collect()}
    for i, block, name in asked:
        own = set(name.split())
        best = max((len(own & set(o.split())) / len(own | set(o.split())), -j) for j, b, o in held if b == block)
        assert found[i] == (-best[1], best[0], -best[1] / 2)
