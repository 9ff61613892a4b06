"""Joins with provenance, best matches, and similarity in a block of any size."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import token_jaccard, token_set
from ..session import cut_lineage
from .intervals import shared_values

# Days per bucket when a date window is taken apart.
BUCKET_DAYS = 11
# Names on one shelf of an index, about.
SHELF = 512
# Names asked for that meet a shelf together, about, and pairs from which the two are compared as matrices.
ASKED = 256
MATRIX = 1024
# Pairs per name up to which a block is joined.
FEW = 32
# Rows up to which a table of words or blocks is sent to every task.
SENT = 100_000
# Thresholds through which the search for the best name falls, and from how many entries of a name's words on.
FALLING = (0.8, 0.6, 0.4, 0.2)
HOT_LISTS = 4096


def join_with_source(left: DataFrame, register: DataFrame, on: str, source: str,
                     name: str = "location_source") -> DataFrame:
    """Left join to a table with one row per key; ``name`` says where the match came from, NULL without one."""
    flagged = register.withColumn("_found", F.lit(True))
    return left.join(flagged, on, "left").withColumn(name, F.when(F.col("_found"), source)).drop("_found")


def units_missing(latest: DataFrame, register: DataFrame) -> DataFrame:
    """Units with results that the register does not hold."""
    return latest.join(register.select("unit_id"), "unit_id", "left_anti")


def lookup_fill(df: DataFrame, lookup: DataFrame, on: str, column: str) -> DataFrame:
    """Fill NULLs of ``column`` from a table with one row per ``on``; known values stay."""
    filled = lookup.select(on, F.col(column).alias("_filled"))
    return (df.join(filled, on, "left").withColumn(column, F.coalesce(column, "_filled"))
            .select(*df.columns))


def match_rate(df: DataFrame, lookup: DataFrame, on: str, warn_below: float = 0.9) -> DataFrame:
    """One row: how many rows there are, the share whose key the lookup holds, and whether that is low.

    Rows are counted per key first, so a key that very many rows share meets the lookup once.
    """
    keys = lookup.select(on).distinct().withColumn("_found", F.lit(1))
    counted = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).join(keys, on, "left")
    totals = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                         F.sum(F.col("_n") * F.coalesce("_found", F.lit(0))).alias("_hits"))
    return totals.select("n_rows", F.try_divide("_hits", "n_rows").alias("rate")).withColumn(
        "is_low", F.col("rate") < warn_below)


def filled_rate(df: DataFrame, column: str) -> DataFrame:
    """One row: the share of rows where ``column`` is known."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(column).isNotNull().cast("double")).alias("rate"))


def _merged(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle. Whether a table may go through the driver Spark judges by the size of its files, and
    it takes an array for one value; names in memory are many times as large."""
    return df.hint("merge")


def _sent(df: DataFrame) -> DataFrame:
    """A written table, to be sent to every task if it has few rows, and else to be joined by a shuffle."""
    return df.hint("broadcast") if df.count() <= SENT else _merged(df)


def _ranked(names: DataFrame, tokens: str, words: DataFrame, blocks: DataFrame) -> DataFrame:
    """``names`` with ``ranked``, its words as ``(n, word)``, rarest first, and ``n_block``: how many names of the register
    have a word in a block, and how many the block has. A word that none has comes first with zero."""
    single = names.withColumn("word", F.explode_outer(tokens)).join(words, ["block", "word"], "left")
    entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
    ranked = single.groupBy(*names.columns).agg(
        F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), entry))).alias("ranked"))
    return ranked.join(blocks, "block", "left")


def _named(tokens: str) -> Column:
    """Words as 64-bit names, which are compared faster; two words of one block share one with probability below 1e-9 up
    to a hundred thousand words."""
    return F.transform(tokens, lambda word: F.xxhash64(word))


def _prefix(tokens: str, level: float) -> Column:
    """The words of ``ranked`` one of which a name must share with any name at least ``level`` alike."""
    size = F.size(tokens)
    fewest = F.greatest(F.ceil(size * F.lit(level) - 1e-9).cast("int"), F.lit(1))
    return F.slice("ranked", F.lit(1), size - fewest + 1)


def _entries_met() -> Column:
    """How many entries of the register a name meets under all its words."""
    return F.aggregate("ranked", F.lit(0).cast("long"), lambda total, w: total + w["n"])


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names asked for (column 2) with a shelf (column 3): for each the most words in common, smallest id on ties."""
    for batch in rows:
        for i in range(batch.num_rows):
            asked, names = batch.column(2)[i].values, batch.column(3)[i].values
            ids = names.field("id").to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")
            shared = shared_values(asked.field("words"), names.field("words").take(pa.array(by_id)))
            best = shared.argmax(axis=1)  # the first of equal ones
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * len(asked), batch.column(0).type), asked.field("tokens"),
                 pa.array(np.full(len(asked), batch.column(1)[i].as_py(), np.int32)),
                 pa.array(shared[np.arange(len(asked)), best].astype(np.int32)), pa.array(-ids[by_id][best])],
                ["block", "tokens", "size", "shared", "minus_id"])


def _best_of_shelves(asked: DataFrame, held: DataFrame, level: float) -> DataFrame:
    """For names with a partner at least ``level`` alike the most similar one, smallest id on ties, as ``best``.

    The register's names stand on shelves, a bounded number of names of one size that share a word. A name looks through
    each shelf of its rarest words, together with others of its size and as matrices where both are many, so that a row
    comes out per shelf, not per pair. Where the lists
    of its words are longer than the block, which is a list too, it looks through that, so that it meets nobody twice.
    """
    of_block = F.array(F.struct(F.col("n_block").alias("n"), F.lit("").alias("word")))
    prefix, own_prefix = _prefix("r_tokens", level), _prefix("tokens", level)
    if level == 0:
        prefix = F.concat(prefix, of_block)
        own_prefix = F.when(_entries_met() > F.col("n_block"), of_block).otherwise(own_prefix)
    entry = held.select("block", _named("r_tokens").alias("words"), "r_id", F.size("r_tokens").alias("size"),
                        F.explode(prefix).alias("entry"))
    shelf = F.pmod(F.xxhash64("r_id"), F.ceil(F.col("entry.n") / F.lit(float(SHELF))).cast("long"))
    shelves = entry.groupBy("block", F.col("entry.word").alias("word"), "size", shelf.alias("shelf")).agg(
        F.collect_list(F.struct("words", F.col("r_id").alias("id"))).alias("names"))
    wanted = asked.select("block", "tokens", _named("tokens").alias("words"), F.explode(own_prefix).alias("entry")).filter(
        "entry.n > 0").select("block", F.col("entry.word").alias("word"), F.size("tokens").alias("own"),
                              F.struct("tokens", "words").alias("name"))
    # Most names fit one cell, so the table of the others is small beside them.
    counted = wanted.groupBy("block", "word", "own").agg(F.count(F.lit(1)).alias("n_own")).filter(F.col("n_own") > ASKED)
    cell = F.pmod(F.xxhash64("name"), F.ceil(F.coalesce("n_own", F.lit(1)) / F.lit(float(ASKED))).cast("long"))
    cells = wanted.join(counted, ["block", "word", "own"], "left").groupBy("block", "word", "own", cell.alias("cell")).agg(
        F.collect_list("name").alias("asked"))
    near = (F.col("size") >= F.col("own") * F.lit(level) - 1e-9) & (F.col("size") * F.lit(level) <= F.col("own") + 1e-9)
    met = cells.join(_merged(shelves), ["block", "word"]).filter(near)
    large = F.size("asked") * F.size("names") >= MATRIX
    # On one shelf all names have one size, so the most words in common is the most similar.
    one = met.filter(~large).select("block", "size", "names", F.inline("asked")).select(
        "block", "tokens", "size", F.array_max(F.transform("names", lambda y: F.struct(
            F.size(F.array_intersect(F.col("words"), y["words"])).alias("shared"),
            (-y["id"]).alias("minus_id")))).alias("best")).select("block", "tokens", "size", "best.shared", "best.minus_id")
    kinds = dict(met.select("block", F.col("asked.tokens").getItem(0).alias("tokens"),
                            (-F.col("names.id").getItem(0)).alias("minus_id")).dtypes)
    many = met.filter(large).select("block", "size", "asked", "names").mapInArrow(
        _compare, f"block {kinds['block']}, tokens {kinds['tokens']}, size int, shared int, minus_id {kinds['minus_id']}")
    shared = F.col("shared").cast("double")
    met = one.unionByName(many).filter("shared > 0").select("block", "tokens", F.struct(
        (shared / (F.size("tokens") + F.col("size") - shared)).alias("similarity"), "minus_id").alias("best"))
    return (met.groupBy("block", "tokens").agg(F.max("best").alias("best"))
            .filter(F.col("best.similarity") >= F.lit(level - 1e-12)))


def _best_of_crowded(left: DataFrame, right: DataFrame, blocks: DataFrame) -> DataFrame:
    """``best`` of every name of ``left``, by falling thresholds."""
    words = _sent(cut_lineage(right.select("block", F.explode("r_tokens").alias("word")).groupBy("block", "word").agg(
        F.count(F.lit(1)).alias("n"))))
    asked = cut_lineage(_ranked(left, "tokens", words, blocks).filter("n_block IS NOT NULL").withColumn(
        "is_hot", F.least(_entries_met(), "n_block") > HOT_LISTS))
    held = _ranked(right, "r_tokens", words, blocks)

    found, hot = [], asked.filter("is_hot")
    if not hot.isEmpty():
        held = cut_lineage(held)
        for level in FALLING:
            found.append(cut_lineage(_best_of_shelves(hot, held, level)))
            hot = hot.join(_merged(found[-1].select("block", "tokens")), ["block", "tokens"], "left_anti")
    found.append(_best_of_shelves(asked.filter("NOT is_hot").unionByName(hot), held, 0.0))

    # Whoever shares no word with anyone still gets the first unit of the block.
    best = asked.select("block", "tokens", F.struct(
        F.lit(0.0).alias("similarity"), (-F.col("first_id")).alias("minus_id")).alias("best"))
    for more in found:
        best = best.unionByName(more)
    return best.groupBy("block", "tokens").agg(F.max("best").alias("best"))


def best_name_match(missing: DataFrame, register: DataFrame, fields: list[str], min_similarity: float = 0.0,
                    block: tuple[str, str] = ("result_postcode", "postcode"),
                    name: tuple[str, str] = ("result_name", "unit_name"), key: str = "unit_id") -> DataFrame:
    """For every missing unit the register unit of its block with the most similar name, the smallest id on ties.

    Returns ``key``, ``match_id``, ``similarity`` and the register's ``fields``. Names of a block of few are compared as they
    are. In other blocks the search falls through thresholds: a
    name that has a partner at least as alike as the threshold shares one of its rarest words with it, the fewer words the
    higher the threshold, and all such partners are found, so the best of them is the best of all. Only names without one
    go on to the next threshold. Names whose words are rare look up all of them at once. Rows are a name's words times
    the shelves that hold them, never pairs of names, and a name may have any number of words.
    """
    left = cut_lineage(missing.filter(F.col(block[0]).isNotNull())
                       .select(F.col(block[0]).alias("block"), token_set(name[0]).alias("tokens")).distinct())
    right = cut_lineage(
        register.filter(F.col(block[1]).isNotNull())
        .select(F.col(block[1]).alias("block"), token_set(name[1]).alias("r_tokens"), F.col(key).alias("r_id"))
        .groupBy("block", "r_tokens").agg(F.min("r_id").alias("r_id")))
    blocks = right.groupBy("block").agg(F.count(F.lit(1)).alias("n_block"), F.min("r_id").alias("first_id"))
    crowded = _sent(cut_lineage(left.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(_merged(blocks), "block").filter(
        F.col("n") * F.col("n_block") > FEW * (F.col("n") + F.col("n_block"))).select("block", "n_block", "first_id")))
    few, few_held = (df.join(crowded, "block", "left_anti") for df in (left, right))
    best = few.join(_merged(few_held), "block").groupBy("block", "tokens").agg(F.max(F.struct(
        token_jaccard("tokens", "r_tokens").alias("similarity"), (-F.col("r_id")).alias("minus_id"))).alias("best"))
    if not crowded.isEmpty():
        best = best.unionByName(_best_of_crowded(*(df.join(crowded, "block", "left_semi") for df in (left, right)), crowded))
    best = best.select("block", "tokens", F.col("best.similarity").alias("similarity"),
                       (-F.col("best.minus_id")).alias("match_id")).filter(F.col("similarity") >= min_similarity)

    keyed = missing.select(key, F.col(block[0]).alias("block"), token_set(name[0]).alias("tokens"))
    matched = keyed.join(_merged(best), ["block", "tokens"]).select(key, "match_id", "similarity")
    return matched.join(_merged(register.select(F.col(key).alias("match_id"), *fields)), "match_id").select(
        key, "match_id", "similarity", *fields)


def _entries(names: DataFrame, threshold: float) -> DataFrame:
    """Index entries of each word set: for every size its partner may have, the words one of which both must share.

    Words are taken rarest first, so that common words are rarely an entry.
    """
    single = names.select("block", "tokens", "on_left", "on_right", F.explode("tokens").alias("word"))
    words = single.groupBy("block", "word").agg(F.count(F.lit(1)).alias("n"))
    ordered = (single.join(words, ["block", "word"]).groupBy("block", "tokens", "on_left", "on_right")
               .agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ranked"))
               .select("block", "tokens", "on_left", "on_right", F.col("ranked.word").alias("ranked"),
                       F.size("tokens").alias("size")))
    low = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    high = F.floor(F.col("size") / threshold + 1e-9).cast("int")
    sized = ordered.withColumn("other", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    overlap = F.ceil((F.col("size") + F.col("other")) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    kept = F.expr("slice(ranked, 1, size - overlap + 1)")
    return (sized.withColumn("overlap", F.greatest(overlap, F.lit(1))).filter("overlap <= least(size, other)")
            .select("block", "tokens", "on_left", "on_right", "size", "other", F.explode(kept).alias("word")))


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs of word sets of one block with a Jaccard similarity of at least ``threshold`` (above 0).

    ``names`` is ``(block, tokens, on_left, on_right)``; a pair has its first set on the left and its second on the
    right. Candidates share one of their rarest words and have sizes that can reach the threshold; each pair of word
    sets is met once, however many units carry the names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    once = names.groupBy("block", "tokens").agg(F.max("on_left").alias("on_left"), F.max("on_right").alias("on_right"))
    entries = _entries(once.filter(F.size("tokens") > 0), threshold)
    a = entries.filter("on_left").select("block", "word", "tokens", "size", "other")
    b = entries.filter("on_right").select("block", "word", F.col("tokens").alias("r_tokens"),
                                          F.col("size").alias("other"), F.col("other").alias("size"))
    pairs = a.join(b, ["block", "word", "size", "other"]).select("block", "tokens", "r_tokens").distinct()
    return pairs.filter(token_jaccard("tokens", "r_tokens") >= F.lit(threshold - 1e-12))


def _day(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def _near_any(rows: DataFrame, others: DataFrame, names: list[str], day: str, other_day: str, gap: int) -> DataFrame:
    """Rows that have any row of the other side about ``gap`` days away: one semi join over three wide buckets."""
    wide = float(gap + 1)
    buckets = others.select(*names, F.floor(F.col(other_day) / F.lit(wide)).cast("int").alias("_wide")).distinct()
    steps = F.array(*[F.floor(F.col(day) / F.lit(wide)).cast("int") + F.lit(i) for i in (-1, 0, 1)])
    spread = rows.withColumn("_wide", F.explode(steps))
    return spread.join(buckets, [*names, "_wide"], "left_semi").drop("_wide").distinct()


def interval_hubs(register: DataFrame, max_gap_days: int = 60, min_similarity: float = 0.5,
                  block: str = "postcode", name: str = "unit_name", key: str = "unit_id",
                  ends: str = "close_date", starts: str = "open_date") -> tuple[DataFrame, DataFrame]:
    """Closed and opened units as members of hubs ``(block, names, days)``.

    A closed and an opened unit share a hub, and exactly one, if they are in one block, their names are similar enough
    and the dates at most ``max_gap_days`` apart. The days around a closing date are taken apart into whole buckets and
    single days, so that a hub holds nothing but true matches. This lists the pairs of names; ``intervals`` has what can
    be told without them.
    """
    named = register.filter(F.col(block).isNotNull()).select(
        F.col(block).alias("block"), token_set(name).alias("tokens"), F.col(key).alias("unit"),
        _day(ends).alias("end"), _day(starts).alias("start"))
    closed = named.filter(F.col("end").isNotNull())
    opened = named.filter(F.col("start").isNotNull())
    # Names meet only inside a run of days: that of an opening date, and those around a closing date.
    wide = float(max_gap_days + 1)
    near = F.array(*[F.floor(F.col("end") / F.lit(wide)).cast("int") + F.lit(i) for i in (-1, 0, 1)])
    run = F.struct("block", "run").alias("block")
    on_left = closed.select("block", "tokens", F.explode(near).alias("run")).select(
        run, "tokens", F.lit(True).alias("on_left"), F.lit(False).alias("on_right"))
    on_right = opened.select("block", "tokens", F.floor(F.col("start") / F.lit(wide)).cast("int").alias("run")).select(
        run, "tokens", F.lit(False).alias("on_left"), F.lit(True).alias("on_right"))
    names = similar_names(on_left.unionByName(on_right), min_similarity).withColumn("block", F.col("block.block"))
    words, r_words = F.array_join("tokens", " ").alias("words"), F.array_join("r_tokens", " ").alias("r_words")
    names = cut_lineage(names.select("block", words, r_words).distinct())
    pair = ["block", "words", "r_words"]
    ended = closed.select("block", words, "unit", "end").join(names, ["block", "words"])
    begun = opened.select("block", F.array_join("tokens", " ").alias("r_words"), "unit", "start").join(
        names, ["block", "r_words"])
    ended = _near_any(ended, begun, pair, "end", "start", max_gap_days)

    low, high = F.col("end") - max_gap_days, F.col("end") + max_gap_days
    first = F.ceil(low / F.lit(float(BUCKET_DAYS))).cast("int")
    last = (F.floor((high + 1) / F.lit(float(BUCKET_DAYS))) - 1).cast("int")
    none = F.array().cast("array<int>")
    whole = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    before = F.when(first <= last, F.when(low < first * BUCKET_DAYS, F.sequence(low, first * BUCKET_DAYS - 1))
                    .otherwise(none)).otherwise(F.sequence(low, high))
    after = F.when((first <= last) & ((last + 1) * BUCKET_DAYS <= high),
                   F.sequence((last + 1) * BUCKET_DAYS, high)).otherwise(none)
    # Buckets and days share one number: a bucket is even, a day odd.
    spans = F.concat(F.transform(whole, lambda b: b * 2), F.transform(F.concat(before, after), lambda d: d * 2 + 1))
    days = F.array(F.floor(F.col("start") / F.lit(float(BUCKET_DAYS))).cast("int") * 2, F.col("start") * 2 + 1)
    return (ended.select("unit", *pair, F.explode(spans).alias("span")),
            begun.select("unit", *pair, F.explode(days).alias("span")))


HUB = ["block", "words", "r_words", "span"]
