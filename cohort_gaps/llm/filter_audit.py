"""Interaction of five text filters: what each removes in every order, from the counts of 32 coalitions.

A coalition is a set of filters; its worth is the number of documents that any of them removes. One row per document and
one per part and failure mask is all that is ever shuffled: the removal game of a part is read off at most 32 counts, so
no order is run on documents. The Hart-Mas-Colell potential of a coalition is ``(worth + potentials without one of its
filters) / size``; a filter's Shapley value is the grand potential less the potential without that filter. Times 120, the
number of orders, all of it is whole numbers.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch

FILTERS = "ABCDE"
ORDERS = 120
EVERYBODY = 31

SPACES = "[ \\t-\\r]+"


def _words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, SPACES), lambda word: word != "")


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, copy_of)`` of every row of ``docs``.

    ``mask`` has a bit per failed filter: A (1) under 50 words; B (2) fewer than 65 distinct words in a hundred; C (4) more
    than 5 capitals in a hundred code points; D (8) any of ``#$%&*|``; E (16) equal to the text of a smaller ``doc_id``. A
    null text is an empty one and a null source the part ``""``. Whole texts are judged, however long. Rows without a
    ``doc_id`` are no smaller than any and have none smaller; rows that repeat a ``doc_id`` are no copies of each other.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                      text.alias("text"))
    words = own.withColumn("words", _words(F.col("text"))).select(
        "doc_id", "part", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.char_length("text").cast("long").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
        # Texts are told apart by their digest and their length.
        F.concat(F.sha2("text", 256), F.lit(":"), F.octet_length("text").cast("string")).alias("digest"))
    mask = (F.when(F.col("n") < 50, 1).otherwise(0)
            + F.when(F.lit(100).cast("long") * F.col("n_distinct") < F.lit(65).cast("long") * F.col("n"), 2).otherwise(0)
            + F.when(100 * F.col("n_capitals") > 5 * F.col("n_chars"), 4).otherwise(0)
            + F.when(F.col("has_symbol"), 8).otherwise(0))
    # Written, so that whole texts are read once for the counts and for the join.
    judged = cut_lineage(words.select("doc_id", "part", "digest", mask.cast("int").alias("mask")))
    # Counted before the shuffle, so a text that very many rows share is one row per task.
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).filter(
        "copy_of < last").select("digest", "copy_of")
    joined = judged.join(first, "digest", "left")
    is_copy = F.coalesce(F.col("copy_of") < F.col("doc_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(is_copy, 16).otherwise(0)).alias("mask"),
                         F.when(is_copy, F.col("copy_of")).alias("copy_of"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``; a document is good or toxic if any row of ``labels`` says so."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    return failures(docs).join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0)).cast("long")).alias("n_good"),
        F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("n_toxic"))


def _worths(name: str) -> Column:
    """What each of the 32 coalitions removes: the documents whose mask meets it."""
    def worth(coalition: Column) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda total, m: total + F.when(
            m["mask"].bitwiseAND(coalition) != 0, m[name]).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(EVERYBODY)), worth)


def _potentials(worths: str) -> Column:
    """120 times the potential of each coalition, by its number: each follows from those with one filter less."""
    def next_one(known: Column, coalition: Column) -> Column:
        below = sum((F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, coalition - (1 << i))).otherwise(0)
                     for i in range(len(FILTERS))), F.lit(0).cast("long"))
        # Always whole: 60 divides by every size, and so does what any coalition adds to its own parts.
        return F.array_append(known, F.round((F.get(worths, coalition) * ORDERS + below) / F.bit_count(coalition))
                              .cast("long"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EVERYBODY)), F.array(F.lit(0).cast("long")), next_one)


def coalitions(counts: DataFrame) -> DataFrame:
    """Per part the number of documents and, as arrays by coalition, what each removes of all, of the good and of the
    toxic documents, and 120 times its potential."""
    masks = counts.groupBy("part").agg(F.sum("n").alias("n_docs"), F.collect_list(
        F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))
    worth = masks.select("part", "n_docs", _worths("n").alias("worth"), _worths("n_good").alias("good"),
                         _worths("n_toxic").alias("toxic"))
    return worth.withColumn("potential", _potentials("worth"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order of the five filters and step, with what the step's filter does there.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (failing the filter, removed earlier), ``unique_fails``
    (failing this filter alone), ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``, removed by the filter in
    all 120 orders together: 120 times its Shapley value. An empty table has no parts and gives no rows; columns of ``docs``
    and ``labels`` beside those named change nothing.
    """
    orders = [F.lit("".join(order)) for order in permutations(FILTERS)]
    with scratch(docs.sparkSession) as own:
        counts = cut_lineage(mask_counts(docs, labels))
        own.keep_all_of([counts])
    rows = coalitions(counts).withColumn("filter_order", F.explode(F.array(*orders))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(name)), 1 << i).otherwise(0) for i, name in enumerate(FILTERS)),
                   F.lit(0))

    order, step = F.col("filter_order"), F.col("step")
    rows = rows.withColumns({"own": bits(F.substring(order, step, F.lit(1))),
                             "before": bits(F.substring(order, F.lit(1), step - 1))})
    rows = rows.withColumn("after", F.col("before") + F.col("own"))
    removed = F.get("worth", "after") - F.get("worth", "before")
    shapley = F.get("potential", F.lit(EVERYBODY)) - F.get("potential", F.lit(EVERYBODY) - F.col("own"))
    return rows.select(
        "part", "filter_order", "step", (F.col("n_docs") - F.get("worth", "after")).alias("kept"),
        removed.alias("removed"), (F.get("worth", "own") - removed).alias("redundant"),
        (F.get("worth", F.lit(EVERYBODY)) - F.get("worth", F.lit(EVERYBODY) - F.col("own"))).alias("unique_fails"),
        (F.get("good", "after") - F.get("good", "before")).alias("good_lost"),
        (F.get("toxic", "after") - F.get("toxic", "before")).alias("toxic_lost"),
        shapley.alias("shapley"))


ORACLE = """
WITH judged AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words
  FROM documents),
failed AS (
  SELECT j.part, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B,
         100 * length(regexp_replace(j.text, '[^A-Z]', '', 'g')) > 5 * length(j.text) AS C,
         regexp_matches(j.text, '[#$%&*|]') AS D,
         coalesce(j.doc_id > min(j.doc_id) OVER (PARTITION BY j.text), false) AS E,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM judged j LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
                           FROM labels GROUP BY doc_id) l ON j.doc_id = l.doc_id),
long AS (
  SELECT part, good, toxic, row_number() OVER () AS row_no, A, B, C, D, E FROM failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
states AS (
  SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
         || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM long GROUP BY ALL),
walked AS (
  SELECT s.part, o.filter_order, k.step, substr(o.filter_order, k.step, 1) AS f, s.n, s.n_good, s.n_toxic, s.fails,
         length(s.fails) AS n_fails,
         coalesce(list_min([x FOR x IN [1, 2, 3, 4, 5] IF contains(s.fails, substr(o.filter_order, x, 1))]), 6) AS goes_at
  FROM states s, orders o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k),
steps AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN goes_at > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN goes_at = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN contains(fails, f) AND goes_at < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN goes_at = step THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN goes_at = step THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""
