"""Closed and opened units with near dates and similar names, in blocks of any size and without a list of pairs.

Units of one block, name and date are one member. Members of a block of few are joined as they are. In other blocks members
meet under one of their rarest words, inside a run of days and for the sizes that can reach the similarity; a pair of them
is met under one key only. Keys that few share are joined. Under all others the members stand in cells of bounded size, and two cells are compared as a whole by one task, which
hands on a row per member instead of one per pair. Every cell meets itself and the first one; after that, cells whose
members are already all connected have nothing to add, and only the others meet. The comparison is arithmetic on small
matrices, which is why it leaves the JVM.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import token_set
from ..session import cut_lineage
from .components import connected_components, local_roots

# Members of a cell in the mean, and pairs per member up to which a key is joined.
CELL = 256
LIGHT = 8
# Pairs per member up to which a block is joined.
FEW = 32
# Columns of a matrix built at once.
COLUMNS = 4096

# A key: the sizes are those of the closed and of the opened unit's name.
KEY = ["block", "run", "word", "closed_size", "opened_size"]
CLOSED, OPENED = 1, 2
MET = "side int, atom long, rep long, root long, n long"


def _day(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def _units(register: DataFrame, block: str, name: str, key: str, ends: str, starts: str) -> DataFrame:
    """``block, words, unit, end, start`` of units with a block and a name; words are known by 64-bit hashes."""
    return register.filter(F.col(block).isNotNull()).select(
        F.col(block).alias("block"), F.transform(token_set(name), lambda w: F.xxhash64(w)).alias("words"),
        F.col(key).cast("long").alias("unit"), _day(ends).alias("end"), _day(starts).alias("start")).filter(
        F.size("words") > 0)


def _sides(units: DataFrame) -> DataFrame:
    """A row per unit and date, with ``atom``, the name of all units of one block, name and date."""
    dates = F.array(F.struct(F.lit(CLOSED).alias("side"), F.col("end").alias("day")),
                    F.struct(F.lit(OPENED).alias("side"), F.col("start").alias("day")))
    return (units.select("block", "words", "unit", F.inline(dates)).filter("day IS NOT NULL")
            .withColumn("atom", F.xxhash64("block", "words", "day")))


def _members(sides: DataFrame) -> DataFrame:
    """One row per atom and side: its largest unit as ``rep`` and how many units it has."""
    return sides.groupBy("block", "words", "day", "side", "atom").agg(
        F.max("unit").alias("rep"), F.count(F.lit(1)).alias("n"))


def _crowded(members: DataFrame) -> DataFrame:
    """Blocks with more than FEW pairs per member, as a written table, so that its size is known."""
    closed, opened = (F.count_if(F.col("side") == s) for s in (CLOSED, OPENED))
    return cut_lineage(members.groupBy("block").agg(closed.alias("n_closed"), opened.alias("n_opened")).filter(
        F.col("n_closed") * F.col("n_opened") > FEW * (F.col("n_closed") + F.col("n_opened"))).select("block"))


def _met(members: DataFrame, gap: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """All pairs of members of blocks of few and under keys that few share, as ``_joined`` has them, and the entries under
    the other keys; None without any."""
    crowded = _crowded(members)

    def side(number: int, mark: str) -> DataFrame:
        return members.filter(F.col("side") == number).join(crowded, "block", "left_anti").select(
            "block", F.struct("atom", "rep", "n").alias(f"{mark}_unit"), F.col("day").alias(f"{mark}_day"),
            F.col("words").alias(f"{mark}_words"))

    near = side(CLOSED, "c").join(side(OPENED, "o"), "block").filter(F.abs(F.col("c_day") - F.col("o_day")) <= gap)
    pairs = near.filter(_alike(least)).select(F.col("c_unit").alias("closed"), F.col("o_unit").alias("opened"))
    if crowded.isEmpty():
        return cut_lineage(pairs), None
    entries = cut_lineage(_entries(members.join(crowded, "block", "left_semi"), gap, least))
    hot = entries.filter(_is_hot())
    return cut_lineage(pairs.unionByName(_joined(entries, gap, least))), None if hot.isEmpty() else hot


def _alike(least: float) -> Column:
    shared = F.size(F.array_intersect("c_words", "o_words")).cast("double")
    return shared / (F.size("c_words") + F.size("o_words") - shared) >= F.lit(least - 1e-12)


def _entries(members: DataFrame, gap: int, least: float) -> DataFrame:
    """Members under the keys where they look for partners, with ``earlier``, the words of rarer keys, and the number of
    members of either side under the key.

    An opened member stands in the run of its day, a closed one in the three runs that its days touch. For each size of
    a partner's name there is a number of rarest words one of which both must share. Words are rare by the pairs they
    would make; words of one side only come first, which is to say that they are left out and fewer others are left.
    """
    run = F.floor(F.col("day") / F.lit(float(gap + 1))).cast("int")
    placed = members.withColumn("run", F.explode(F.when(F.col("side") == CLOSED, F.array(run - 1, run, run + 1))
                                                 .otherwise(F.array(run))))
    single = placed.withColumn("word", F.explode("words"))
    words = single.groupBy("block", "run", "word").agg(
        (F.count_if(F.col("side") == CLOSED) * F.count_if(F.col("side") == OPENED)).alias("met")).filter("met > 0")
    ranked = single.join(words, ["block", "run", "word"]).groupBy(
        "block", "run", "side", "atom", "day", "rep", "n", "words").agg(
        F.sort_array(F.collect_list(F.struct("met", "word"))).alias("ranked"))
    size = F.size("words")
    low, high = F.ceil(size * least - 1e-9).cast("int"), F.floor(size / least + 1e-9).cast("int")
    sized = ranked.withColumn("size", size).withColumn(
        "other", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    overlap = F.greatest(F.ceil((F.col("size") + F.col("other")) * (least / (1 + least)) - 1e-9).cast("int"), F.lit(1))
    sized = sized.withColumn("overlap", overlap).filter("overlap <= least(size(ranked), other)").withColumn(
        "prefix", F.expr("slice(ranked, 1, size(ranked) - overlap + 1)"))
    closed = F.col("side") == CLOSED
    entries = sized.select(
        "block", "run", F.when(closed, F.col("size")).otherwise(F.col("other")).alias("closed_size"),
        F.when(closed, F.col("other")).otherwise(F.col("size")).alias("opened_size"), "side", "atom", "day", "rep", "n",
        "words", "prefix", F.posexplode("prefix").alias("at", "entry")).select(
        "block", "run", F.col("entry.word").alias("word"), "closed_size", "opened_size", "side", "atom", "day", "rep", "n",
        "words", F.expr("slice(prefix.word, 1, at)").alias("earlier"))
    entries = cut_lineage(entries)
    keys = entries.groupBy(*KEY).agg(F.count_if(F.col("side") == CLOSED).alias("n_closed"),
                                     F.count_if(F.col("side") == OPENED).alias("n_opened"))
    return entries.join(keys.filter("n_closed > 0 AND n_opened > 0"), KEY)


def _is_hot() -> Column:
    return F.col("n_closed") * F.col("n_opened") > LIGHT * (F.col("n_closed") + F.col("n_opened"))


def _joined(entries: DataFrame, gap: int, least: float) -> DataFrame:
    """Pairs of members under keys that few share, as ``closed`` and ``opened`` of ``(atom, rep, n)``."""
    kept = [F.struct("atom", "rep", "n"), F.col("day"), F.col("words"), F.col("earlier")]

    def side(number: int, mark: str) -> DataFrame:
        return entries.filter((F.col("side") == number) & ~_is_hot()).select(
            *KEY, *[c.alias(f"{mark}_{n}") for c, n in zip(kept, ("unit", "day", "words", "earlier"))])

    pairs = side(CLOSED, "c").join(side(OPENED, "o"), KEY).filter(
        (F.abs(F.col("c_day") - F.col("o_day")) <= gap) & ~F.arrays_overlap("c_earlier", "o_earlier"))
    return pairs.filter(_alike(least)).select(F.col("c_unit").alias("closed"), F.col("o_unit").alias("opened"))


def _matrix(lists: pa.ListArray, known: np.ndarray) -> np.ndarray:
    """One row per list with 1 in the column of each of its values that is among ``known``."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    found = known[at] == values
    out = np.zeros((len(lists), len(known)), np.float32)
    out[rows[found], at[found]] = 1
    return out


def shared_values(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many values each list on the left has in common with each on the right."""
    def values(lists: pa.ListArray) -> np.ndarray:
        offsets = lists.offsets.to_numpy()
        return lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]

    both = np.intersect1d(values(left), values(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), COLUMNS):
        known = both[at:at + COLUMNS]
        out += _matrix(left, known) @ _matrix(right, known).T
    return out


def _compare(gap: int, least: float, counting: bool):
    """A task's work: cells of closed members (column 0) with cells of opened ones (column 1).

    Rows are MET: for every member with a partner the name of its local group, and with ``counting`` also the number of
    units of all its partners. Without, pairs that are already connected are left out.
    """
    def columns(cell: pa.StructArray) -> dict:
        plain = {name: cell.field(name).to_numpy(zero_copy_only=False) for name in ("atom", "rep", "day", "n", "label", "is_met")}
        return {**plain, "words": cell.field("words"), "earlier": cell.field("earlier")}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                a, b = columns(batch.column(0)[i].values), columns(batch.column(1)[i].values)
                near = np.abs(a["day"][:, None].astype(np.int64) - b["day"][None, :]) <= gap
                if not counting:
                    known = (a["label"][:, None] == b["label"][None, :]) & a["is_met"][:, None] & b["is_met"][None, :]
                    near &= ~known
                if not near.any():
                    continue
                # Two members that share the word of a rarer key meet there.
                near &= shared_values(a["earlier"], b["earlier"]) == 0
                shared = shared_values(a["words"], b["words"]).astype(np.float64)
                total = np.diff(a["words"].offsets.to_numpy())[:, None] + np.diff(b["words"].offsets.to_numpy())[None, :]
                near &= shared / (total - shared) >= least - 1e-12
                at, to = np.nonzero(near)
                if len(at) == 0:
                    continue
                nodes, roots = local_roots(a["rep"][at], b["rep"][to])
                for side, cell, met, others in ((CLOSED, a, near.any(axis=1), near @ b["n"]),
                                                (OPENED, b, near.any(axis=0), a["n"] @ near)):
                    reps = cell["rep"][met]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(reps), side, np.int32)), pa.array(cell["atom"][met]), pa.array(reps),
                         pa.array(roots[np.searchsorted(nodes, reps)]), pa.array(others[met].astype(np.int64))],
                        ["side", "atom", "rep", "root", "n"])

    return batches


def _cells(hot: DataFrame) -> DataFrame:
    """Members of a key and side in cells, by ``bin``; ``label`` is the group that all members of a cell are known to be
    in, NULL where there is none."""
    return hot.groupBy(*KEY, "side", "bin").agg(
        F.collect_list(F.struct("atom", "rep", "day", "n", "label", "is_met", "words", "earlier")).alias("cell"),
        F.when(F.bool_and("is_met") & (F.min("label") == F.max("label")), F.min("label")).alias("label"))


def _met_in_cells(hot: DataFrame, which: Column, gap: int, least: float, counting: bool = False) -> DataFrame:
    """MET of the pairs of cells that ``which`` chooses by ``c_bin``, ``o_bin``, ``c_label`` and ``o_label``.

    The pairs are chosen by number first, so that a key's pairs of cells are dealt to tasks by cell, not by key.
    """
    cells = cut_lineage(_cells(hot))

    def side(number: int, mark: str, name: str) -> DataFrame:
        return cells.filter(F.col("side") == number).select(
            *KEY, F.col("bin").alias(f"{mark}_bin"), F.col(name).alias(f"{mark}_{name}"))

    chosen = side(CLOSED, "c", "label").join(side(OPENED, "o", "label"), KEY).filter(which).select(*KEY, "c_bin", "o_bin")
    met = chosen.join(side(CLOSED, "c", "cell"), [*KEY, "c_bin"]).join(side(OPENED, "o", "cell"), [*KEY, "o_bin"])
    return cut_lineage(met.select("c_cell", "o_cell").mapInArrow(_compare(gap, least, counting), MET))


def _dealt(n: Column, seed: str = "atom") -> Column:
    return F.pmod(F.xxhash64(F.col(seed), F.lit(1)), F.ceil(n / F.lit(float(CELL))).cast("long"))


def _own_number() -> Column:
    return F.when(F.col("side") == CLOSED, F.col("n_closed")).otherwise(F.col("n_opened"))


def _rebinned(hot: DataFrame, groups: DataFrame, met: DataFrame) -> DataFrame:
    """Members of keys with several cells, dealt anew by the groups that they are in: a large group has cells of its own."""
    several = hot.filter(F.greatest("n_closed", "n_opened") > CELL).drop("label", "is_met", "bin")
    known = met.select("side", "atom", "rep").distinct().join(
        groups.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left")
    several = several.join(known.withColumn("is_met", F.lit(True)), ["side", "atom", "rep"], "left").withColumns(
        {"label": F.coalesce("label", "rep"), "is_met": F.coalesce("is_met", F.lit(False))})
    # Only groups that fill a cell are counted, so the second table is small beside the first.
    large = several.filter("is_met").groupBy(*KEY, "side", "label").agg(F.count(F.lit(1)).alias("n_group")).filter(
        F.col("n_group") >= CELL).withColumn("is_met", F.lit(True))
    own = F.struct(F.col("label").alias("of"), _dealt(F.col("n_group")).alias("cell"))
    mixed = F.struct(F.lit(None).cast("long").alias("of"), _dealt(_own_number(), "label").alias("cell"))
    binned = several.join(large, [*KEY, "side", "label", "is_met"], "left")
    return binned.withColumn("bin", F.to_json(F.when(F.col("n_group").isNotNull(), own).otherwise(mixed))).drop("n_group")


def interval_similarity_edges(register: DataFrame, max_gap_days: int = 60, min_similarity: float = 0.5,
                              block: str = "postcode", name: str = "unit_name", key: str = "unit_id",
                              ends: str = "close_date", starts: str = "open_date") -> DataFrame:
    """Closed and opened units of one block with near dates and similar names, as edges ``(unit, centre)`` to follow.

    The edges connect exactly the units that a chain of such pairs connects. Of the pairs under a word that very many
    units share, only those are looked for that connect groups which are still apart, and they come out as a row per
    unit, so rows grow with the units also where all pairs are similar.
    """
    _check(min_similarity)
    sides = _sides(_units(register, block, name, key, ends, starts))
    members = cut_lineage(_members(sides))
    pairs, hot = _met(members, max_gap_days, min_similarity)
    met = pairs.select(F.posexplode(F.array("closed", "opened")).alias("place", "one"),
                       F.greatest("closed.rep", "opened.rep").alias("root")).select(
        (F.col("place") + CLOSED).alias("side"), "one.atom", "one.rep", "root", "one.n")
    if hot is not None:
        hot = hot.withColumns({"label": F.col("rep"), "is_met": F.lit(False), "bin": _dealt(_own_number())})
        first = (F.col("c_bin") == F.col("o_bin")) | (F.col("c_bin") == 0) | (F.col("o_bin") == 0)
        met = met.unionByName(_met_in_cells(hot, first, max_gap_days, min_similarity))
        if not hot.filter(F.greatest("n_closed", "n_opened") > CELL).isEmpty():
            groups = connected_components(met, "rep", "root")
            apart = F.col("c_label").isNull() | F.col("o_label").isNull() | (F.col("c_label") != F.col("o_label"))
            met = met.unionByName(_met_in_cells(_rebinned(hot, groups, met), apart, max_gap_days, min_similarity))
    # All units of a member with a partner have that partner; most members are one unit.
    several = cut_lineage(met.select("side", "atom", F.col("rep").alias("centre")).join(
        members.filter("n > 1").select("side", "atom"), ["side", "atom"], "left_semi").distinct())
    shared = sides.select("side", "atom", "unit").join(several, ["side", "atom"]).select("unit", "centre")
    return (met.select(F.col("rep").alias("unit"), F.col("root").alias("centre")).unionByName(shared)
            .filter("unit <> centre").distinct())


def interval_partners(register: DataFrame, max_gap_days: int = 60, min_similarity: float = 0.5,
                      block: str = "postcode", name: str = "unit_name", key: str = "unit_id",
                      ends: str = "close_date", starts: str = "open_date") -> DataFrame:
    """Per unit with a partner how many units it may have turned into and how many may have turned into it.

    Every pair of members is met under one key, and a cell adds up the partners of a member, so no pair of a word that
    very many units share is listed. A unit is no partner of itself.
    """
    _check(min_similarity)
    units = _units(register, block, name, key, ends, starts)
    sides = _sides(units)
    pairs, hot = _met(cut_lineage(_members(sides)), max_gap_days, min_similarity)
    counts = pairs.selectExpr(f"{CLOSED} AS side", "closed.atom AS atom", "opened.n AS n").unionByName(
        pairs.selectExpr(f"{OPENED} AS side", "opened.atom AS atom", "closed.n AS n"))
    if hot is not None:
        hot = hot.withColumns({"label": F.col("rep"), "is_met": F.lit(False), "bin": _dealt(_own_number())})
        counts = counts.unionByName(_met_in_cells(hot, F.lit(True), max_gap_days, min_similarity, counting=True)
                                    .select("side", "atom", "n"))
    counts = counts.groupBy("side", "atom").agg(F.sum("n").alias("n"))
    per_unit = sides.select("unit", "side", "atom").join(counts, ["side", "atom"]).select("unit", "side", "n")
    itself = units.filter(F.abs(F.col("end") - F.col("start")) <= max_gap_days).select(
        "unit", F.explode(F.array(F.lit(CLOSED), F.lit(OPENED))).alias("side"), F.lit(-1).cast("long").alias("n"))
    after, before = (F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)) for s in (CLOSED, OPENED))
    return per_unit.unionByName(itself).groupBy("unit").agg(
        after.alias("n_after"), before.alias("n_before")).filter("n_after + n_before > 0")


def _check(min_similarity: float) -> None:
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0 and at most 1")
