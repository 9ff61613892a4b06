import datetime as dt
import random
import re
from collections import Counter, defaultdict, deque
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohort_gaps.operators import components, dedupe, intervals, joins, ranking
from cohort_gaps.operators.components import connected_components
from cohort_gaps.session import cut_lineage, ensure_checkpoint_dir, scratch

STOP = {"the", "school", "academy", "college", "of", "and", "a", "st", "saint"}


def words(name):
    return Counter(w for w in re.split("[^a-z0-9]+", (name or "").lower()) if w and w not in STOP).keys()


def similarity(a, b):
    """Shared words by all words, counted in one multiset of both."""
    counts = Counter([*words(a), *words(b)])
    return sum(n == 2 for n in counts.values()) / len(counts) if words(a) and words(b) else 0.0


def groups_of(edges):
    """Each node with the largest node that a search from it meets."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in near:
        if start in out:
            continue
        reached, queue = {start}, deque([start])
        while queue:
            for other in near[queue.popleft()] - reached:
                reached.add(other)
                queue.append(other)
        out.update(dict.fromkeys(reached, max(reached)))
    return out


# --- ranks -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of it, some values are missing, one group is all missing."""
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        group = "big" if i % 10 else rnd.choice(["a", "b", None])
        value = None if rnd.random() < 0.05 else 0.5 if rnd.random() < 0.33 else round(rnd.gauss(0, 1), 3)
        rows.append((i, group, value))
    rows += [(9000 + i, "none", None) for i in range(5)]
    return spark.createDataFrame(rows, "i int, g string, v double").repartition(6).cache()


def test_rank_equals_window(skewed):
    plain = F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last()))
    out = ranking.with_rank(skewed, ["g"], "v", "r").withColumn("expected", plain)
    assert out.count() == skewed.count()
    assert out.filter(~F.col("r").eqNullSafe(F.col("expected"))).count() == 0


def test_rank_without_groups_ascending_counts(skewed):
    known = skewed.filter("v IS NOT NULL")
    counts = ranking.running_counts(known, [], "v", descending=False).orderBy("v").collect()
    before = 0
    for row in counts:
        assert row.n_before == before
        before += row.n
    assert before == known.count()


def test_rank_never_sorts_a_whole_group(skewed):
    """Rows are sorted inside range partitions; the sums in front hold one row per group and partition."""
    plan = ranking.with_rank(skewed, ["g"], "v", "r")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and all("_bucket" in line or "_size" in line for line in windows)


def test_rank_rows_do_not_grow_with_map_tasks(spark):
    """The table that is numbered has one row per group and value, however many tasks counted them."""
    for tasks in (2, 40):
        df = spark.range(0, 20000, 1, tasks).select((F.col("id") % 3).alias("g"), (F.col("id") % 500).alias("v"))
        counts = ranking.running_counts(df, ["g"], "v")
        assert counts.count() == 1500
        assert counts.agg(F.sum("n")).first()[0] == 20000


def test_class_breaks(spark):
    values = [5.0, 1.0, 1.0, 1.0, 9.0, 7.0, None, 3.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = ranking.class_breaks(df, "v", 5).orderBy("i").collect()
    known = sorted(v for v in values if v is not None)
    breaks = [known[(i + 1) * len(known) // 5] for i in range(4)]
    assert [rows[0][f"break_{i + 1}"] for i in range(4)] == breaks
    assert [r["class"] for r in rows] == [None if v is None else sum(b <= v for b in breaks) for v in values]


def test_class_breaks_of_nothing(spark):
    rows = ranking.class_breaks(spark.createDataFrame([(1, None)], "i int, v double"), "v").collect()
    assert rows[0]["class"] is None and rows[0].break_1 == 0.0


# --- dedupe ------------------------------------------------------------------------------------------------------

def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = dedupe.keep_first(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_keep_largest_and_latest(spark):
    df = spark.createDataFrame([(1, 10, 2001), (1, None, 2003), (1, 30, 2002), (2, None, 2000)],
                               "unit_id long, n long, period int")
    rows = dedupe.keep_largest(df, ["unit_id"], "n", [F.col("period")]).orderBy("unit_id").collect()
    assert [(r.unit_id, r.n) for r in rows] == [(1, 30), (2, None)]
    assert {(r.unit_id, r.period) for r in dedupe.latest_per_unit(df).collect()} == {(1, 2003), (2, 2000)}


def test_first_non_null_and_mode(spark):
    df = spark.createDataFrame([("a", 2, None, "y"), ("a", 1, None, None), ("a", 3, 7.0, "x"), ("a", 4, 8.0, "x"),
                                ("b", 5, None, None), ("c", 6, 1.0, "q"), ("c", 7, 1.0, "p")],
                               "g string, i int, x double, v string")
    rows = {r.g: r for r in dedupe.first_non_null(df, ["g"], ["x", "v"], "i").collect()}
    assert (rows["a"].x, rows["a"].v, rows["b"].x) == (7.0, "y", None)
    modes = {r.g: r.v for r in dedupe.mode_by_group(df, ["g"], "v").collect()}
    assert modes == {"a": "x", "b": None, "c": "p"}


# --- components --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name,edges", [
    ("path", [(i, i + 1) for i in range(1, 42)]),
    ("star", [(500, i) for i in range(100, 160)]),
    ("ring and loop", [(1, 2), (2, 3), (3, 1), (7, 7), (9, 8), (8, 9)]),
    ("random", [(random.Random(i).randint(0, 80), random.Random(i + 999).randint(0, 80)) for i in range(60)]),
])
@pytest.mark.parametrize("per_task", [7, 1 << 20])
def test_components(spark, name, edges, per_task):
    table = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    out = connected_components(table, "a", "b", per_task=per_task).collect()
    expected = groups_of([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in out} == expected and len(out) == len(expected)
    least = {top: min(n for n, t in expected.items() if t == top) for top in set(expected.values())}
    small = connected_components(table, "a", "b", smallest=True, per_task=per_task).collect()
    assert {r.node: r.component for r in small} == {n: least[t] for n, t in expected.items()}


@pytest.mark.parametrize("n,shuffled", [(100_000, False), (20_000, True)])
def test_components_of_a_long_chain_shrink_by_a_third_per_round(spark, monkeypatch, n, shuffled):
    """Chains dealt to a thousand tasks, where hardly any two neighbouring edges meet: ids in order and at random."""
    counts = []
    ids = list(range(n))
    if shuffled:
        random.Random(4).shuffle(ids)
    table = spark.createDataFrame([*zip(ids, ids[1:])], "a long, b long")
    original = components.cut_lineage

    def counted(df):
        out = original(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    out = connected_components(table, "a", "b", smallest=True, per_task=100)
    assert out.agg(F.count("node"), F.min("component"), F.max("component")).first()[:] == (n, 0, 0)
    assert len(counts) <= 20 and all(b <= a * 2 / 3 for a, b in zip(counts, counts[1:]) if a > 2000)


def test_components_leave_no_tables_behind(spark):
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {*folder.iterdir()}
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    out = connected_components(edges, "a", "b", per_task=40)
    assert len({*folder.iterdir()} - before) == 1 and out.count() == 301


def test_components_of_nothing(spark):
    out = connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert out.columns == ["node", "component"] and out.count() == 0


def test_cut_lineage_uses_the_named_folder(spark):
    ensure_checkpoint_dir(spark)
    table = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    folder = spark.sparkContext.getCheckpointDir().split(":", 1)[-1].lstrip("/")
    assert all(folder in f for f in table.inputFiles())
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert named.rstrip("/").split(":", 1)[-1].lstrip("/") in folder
    assert sorted(r.x for r in table.collect()) == [0, 2, 4, 6, 8]


# --- joins -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def register(spark):
    """Most units share one postcode; names draw on few words, some names are long."""
    rnd = random.Random(11)
    short = ["hill", "park", "green", "oak", "north", "west", "st", "academy", "high", "church", "ash"]
    many = short + [f"q{i}" for i in range(8)]

    def name():
        return " ".join(rnd.sample(short, rnd.randint(0, 5)) if rnd.random() < 0.9 else rnd.sample(many, 12))

    def day():
        return dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 400)) if rnd.random() < 0.6 else None

    rows = [(i, rnd.choice(["A", "A", "B", None]), name(), day(), day()) for i in range(120)]
    missing = [(1000 + i, rnd.choice(["A", "B", None, "C"]), name()) for i in range(60)]
    kind = "unit_id long, postcode string, unit_name string, open_date date, close_date date"
    return (rows, missing, spark.createDataFrame(rows, kind).cache(),
            spark.createDataFrame(missing, "unit_id long, result_postcode string, result_name string").cache())


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_best_name_match_against_all_pairs(register, least):
    rows, missing, table, wanted = register
    expected = {}
    for unit, block, name in missing:
        near = [(-similarity(name, r[2]), r[0]) for r in rows if block is not None and r[1] == block]
        if near and -min(near)[0] >= least:
            expected[unit] = min(near)
    out = joins.best_name_match(wanted, table, ["open_date"], min_similarity=least).collect()
    assert {r.unit_id: (-r.similarity, r.match_id) for r in out} == expected
    opened = {r[0]: r[3] for r in rows}
    assert all(r.open_date == opened[r.match_id] for r in out)


def all_pairs(rows, days, least):
    return {(a[0], b[0]) for a in rows for b in rows
            if a[0] != b[0] and a[1] is not None and a[1] == b[1] and a[4] and b[3]
            and abs((b[3] - a[4]).days) <= days and similarity(a[2], b[2]) >= least}


@pytest.mark.parametrize("days,least", [(60, 0.5), (5, 0.34), (0, 0.34), (200, 0.8), (7, 1.0)])
def test_interval_hubs_hold_the_true_pairs_once(register, days, least):
    rows, _, table, _ = register
    ended, begun = joins.interval_hubs(table, max_gap_days=days, min_similarity=least)
    met = ended.withColumnRenamed("unit", "old").join(begun.withColumnRenamed("unit", "new"), joins.HUB)
    met = [(r.old, r.new) for r in met.filter("old <> new").select("old", "new").collect()]
    assert len(met) == len(set(met)) and set(met) == all_pairs(rows, days, least)


def test_interval_edges_give_the_same_groups(spark, register):
    rows, _, table, _ = register
    edges = [tuple(r) for r in intervals.interval_similarity_edges(table, max_gap_days=60).collect()]
    assert groups_of(edges) == groups_of(all_pairs(rows, 60, 0.5))


def test_one_name_in_one_block_needs_one_edge_per_member(spark):
    """A third of a table in one group: 300 closed and opened units on one day are 300 * 299 pairs, but few edges."""
    day = dt.date(2021, 5, 1)
    df = spark.createDataFrame([(i, "A", "Hill", day, day) for i in range(300)],
                               "unit_id long, postcode string, unit_name string, open_date date, close_date date")
    edges = intervals.interval_similarity_edges(df).collect()
    assert len(edges) == 299 and {r.centre for r in edges} == {299}


def test_long_names_in_one_block_stay_linear(spark):
    """Thousands of nine-word names of one block: sets looked up grow with the names, not with their pairs."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]

    def named(n, first):
        return [(first + i, "P", " ".join(rng.sample(vocabulary, 9))) for i in range(n)]

    rows_seen = []
    original = joins.cut_lineage
    for size in (200, 400):
        rows = []

        def counted(df):
            out = original(df)
            rows.append(out.count())
            return out

        joins.cut_lineage = counted
        try:
            left = spark.createDataFrame(named(size, 0), "unit_id long, result_postcode string, result_name string")
            right = spark.createDataFrame(named(size, 10_000), "unit_id long, postcode string, unit_name string")
            found = joins.best_name_match(left, right, []).collect()
        finally:
            joins.cut_lineage = original
        rows_seen.append(sum(rows))
        theirs = [(r.unit_id, r.unit_name) for r in right.collect()]
        for r in left.collect():
            best = max(((similarity(r.result_name, n), -i) for i, n in theirs))
            match = next(x for x in found if x.unit_id == r.unit_id)
            assert (match.similarity, match.match_id) == (pytest.approx(best[0]), -best[1])
    # Twice the names, about twice the rows; pairs would be four times as many.
    assert rows_seen[1] < 3 * rows_seen[0] and rows_seen[1] < 400 * 400


@pytest.mark.parametrize("hot", [0, 4096])
def test_best_name_of_forty_words(spark, monkeypatch, hot):
    """Names of forty words, equal or with some of them in common: no set of shared words is ever built."""
    monkeypatch.setattr(joins, "HOT_LISTS", hot)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(90)]
    mine = [(i, "P", " ".join(rng.sample(vocabulary, 40))) for i in range(12)]
    theirs = [(100 + i, "P", " ".join(rng.sample(vocabulary, 40))) for i in range(150)] + [(999, "P", mine[3][2])]
    theirs += [(500 + i, "P", " ".join(mine[i][2].split()[:40 - 5 * i] + rng.sample(vocabulary, 5))) for i in range(8)]
    left = spark.createDataFrame(mine, "unit_id long, result_postcode string, result_name string")
    right = spark.createDataFrame(theirs, "unit_id long, postcode string, unit_name string")
    found = {r.unit_id: (r.similarity, r.match_id) for r in joins.best_name_match(left, right, []).collect()}
    best = {i: max((similarity(n, m), -j) for j, _, m in theirs) for i, _, n in mine}
    assert found == {i: (pytest.approx(s), -j) for i, (s, j) in best.items()} and found[3][0] == 1.0


def test_best_name_rows_in_a_hot_block(spark, monkeypatch):
    """Everybody in one block with one common word: rows are names times words times shelves, and all still match."""
    monkeypatch.setattr(joins, "HOT_LISTS", 500)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    left = [(i, "P", "hill " + " ".join(rng.sample(vocabulary, 3))) for i in range(1500)]
    right = [(10_000 + i, "P", "hill " + " ".join(rng.sample(vocabulary, 3))) for i in range(1500)]
    out = joins.best_name_match(
        spark.createDataFrame(left, "unit_id long, result_postcode string, result_name string"),
        spark.createDataFrame(right, "unit_id long, postcode string, unit_name string"), [])
    found = {r.unit_id: (r.similarity, r.match_id) for r in out.collect()}
    sets = [(i, words(n)) for i, _, n in right]
    for i, _, n in left[::15]:
        own = words(n)
        assert found[i] == max((len(own & x) / len(own | x), -j) for j, x in sets)[:1] + (
            -max((len(own & x) / len(own | x), -j) for j, x in sets)[1],)
    assert len(found) == 1500


def test_partners_are_counted_for_every_pair(spark):
    rng = random.Random(12)
    day = dt.date(2020, 1, 1)
    rows = [(i, rng.choice("AB"), " ".join(rng.sample(["hill", "park", "vale", "green", "north"], rng.randint(1, 3))),
             day + dt.timedelta(rng.randint(0, 200)) if rng.random() < 0.7 else None,
             day + dt.timedelta(rng.randint(0, 200)) if rng.random() < 0.7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "unit_id long, postcode string, unit_name string, close_date date, open_date date")
    after, before = Counter(), Counter()
    for a in rows:
        for b in rows:
            if (a[0] != b[0] and a[1] == b[1] and a[3] and b[4] and abs((a[3] - b[4]).days) <= 60
                    and similarity(a[2], b[2]) >= 0.5):
                after[a[0]] += 1
                before[b[0]] += 1
    found = {r.unit: (r.n_after, r.n_before) for r in intervals.interval_partners(df).collect()}
    assert found == {i: (after[i], before[i]) for i in set(after) | set(before)}


def test_names_without_near_dates_are_not_stored(spark):
    old, new = dt.date(2000, 1, 1), dt.date(2020, 1, 1)
    rows = [(i, "A", f"hill park {i % 7}", old, None) for i in range(50)]
    rows += [(100 + i, "A", f"hill park {i % 7}", None, new) for i in range(50)]
    df = spark.createDataFrame(rows, "unit_id long, postcode string, unit_name string, close_date date, open_date date")
    stored, original = [], joins.cut_lineage

    def counted(table):
        out = original(table)
        stored.append(out.count())
        return out

    joins.cut_lineage = counted
    try:
        ended, begun = joins.interval_hubs(df)
        assert ended.count() == 0
    finally:
        joins.cut_lineage = original
    assert stored == [0]


def test_scratch_removes_what_was_written(spark):
    import os

    with scratch(spark) as kept:
        gone = cut_lineage(spark.range(3))
        left = cut_lineage(spark.range(4))
        paths = [df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/") for df in (gone, left)]
        kept.keep_all_of([left])
    assert not os.path.exists(paths[0]) and left.count() == 4


def test_similar_names_rejects_zero(spark):
    df = spark.createDataFrame([("A", ["x"], True, True)],
                               "block string, tokens array<string>, on_left boolean, on_right boolean")
    with pytest.raises(ValueError):
        joins.similar_names(df, 0.0)
    assert joins.similar_names(df, 1.0).count() == 1


def test_null_blocks_never_match(spark):
    left = spark.createDataFrame([(1, None, "Hill")], "unit_id long, result_postcode string, result_name string")
    right = spark.createDataFrame([(2, None, "Hill", 1.0)],
                                  "unit_id long, postcode string, unit_name string, latitude double")
    assert joins.best_name_match(left, right, ["latitude"]).count() == 0


def test_lookup_and_rates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "kept"), (3, None, None), (4, "x", None)],
                               "i int, k string, z string")
    table = spark.createDataFrame([("a", "filled")], "k string, z string")
    rows = joins.lookup_fill(df, table, "k", "z").orderBy("i").collect()
    assert [r.z for r in rows] == ["filled", "kept", None, None]
    rate = joins.match_rate(df, table, "k").first()
    assert (rate.n_rows, rate.rate, rate.is_low) == (4, 0.5, True)
    assert joins.filled_rate(df, "z").first().rate == 0.25
    found = joins.join_with_source(df.drop("z"), table, "k", "source").orderBy("i").collect()
    assert [r.location_source for r in found] == ["source", "source", None, None]
