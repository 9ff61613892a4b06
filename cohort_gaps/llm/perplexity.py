"""Quality by n-gram perplexity: a character trigram model per language with modified Kneser-Ney smoothing.

Symbols are the code points themselves. Spark counts the trigrams of all texts, and continuation counts, discounts and
probabilities are aggregates and joins over the n-grams found, so a model has as many as the texts have. Tasks that score
texts hold the most frequent trigrams, a bounded number; whatever else a text holds is joined to the rest of the model. A
text is kept if its perplexity lies in the band of its language.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .line_dedup import code_points
from .text import IS_SPACE, _mix, combine, previous, slices, sum_per_text, words

# A code point takes 21 bits of a trigram's code; what stands before a text is beyond all code points.
SYMBOL_BITS, PAD = 21, (1 << 21) - 1
# Trigrams that the tasks hold, and entries of a task's counts that are added up at once.
HELD, ENTRIES = 1 << 20, 1 << 22
# Symbols of ``smooth``, the twin for small alphabets.
SYMBOLS = 128
# Half-width of a band in robust standard deviations of the language's log perplexities. Of 291 labelled junk documents that
# pass the base rules 4 keeps 57, and of 3,243 good ones it rejects 64. It was chosen by a model of 128 symbols, where 6 kept
# 156, 5 kept 87, 4 kept 55 and 3 kept 43, and they rejected 41, 49, 64 and 101.
WIDTH = 4.0
# Bands are read from counts of log10 perplexities rounded to this.
STEP = 1e-3
LEAST_WORDS, MOST_REPEATED = 50, 50

IS_SIGN = np.zeros(256, bool)
IS_SIGN[[ord(c) for c in "#*$%&|<>"]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of every character with the two before it, and where those of each text begin."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    per_text = np.searchsorted(heads, offsets)
    own = code_points(data, heads).astype(np.int64)
    return (previous(own, per_text, 2, PAD) << 2 * SYMBOL_BITS | previous(own, per_text, 1, PAD) << SYMBOL_BITS | own), per_text


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``(lang, code, n)`` over all texts, added up inside each task first."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([m for _, m in parts])).astype(np.int64)
                for at in range(0, len(code), 1 << 16):
                    own = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[own]), pa.string()), pa.array(code[own]),
                                                      pa.array(n[own])], ["lang", "code", "n"])
            held.clear()

        for batch in rows:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                for _, data, offsets in slices(batch.column(1).filter(pc.equal(langs, lang))):
                    if len(data):
                        held.setdefault(lang, []).append(np.unique(trigrams(data, offsets)[0], return_counts=True))
                        size += len(held[lang][-1][0])
                if size > ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _smoothed(grams: DataFrame, below: DataFrame | None, order: int) -> DataFrame:
    """``(lang, gram, n, p)`` of one order from its counts: discounted, and interpolated with ``below``, the next lower
    order; the lowest order with equal shares of a language's characters."""
    seen = grams.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n_{k}") for k in (1, 2, 3, 4)],
                                     F.count(F.lit(1)).alias("n_all"))
    share = F.try_divide("n_1", F.col("n_1") + 2 * F.col("n_2"))
    # Where too few n-grams are seen once, twice or three times, 0.5, 1 and 1.5.
    discounts = [F.when((F.col("n_1") > 0) & (F.col("n_2") > 0) & (F.col("n_3") > 0), F.greatest(F.lit(0.05), F.least(
        F.lit(k - 0.05), k - (k + 1) * share * F.try_divide(f"n_{k + 1}", f"n_{k}")))).otherwise(F.lit(0.5 * k)).alias(f"d_{k}")
        for k in (1, 2, 3)]
    cut = F.when(F.col("n") == 1, F.col("d_1")).when(F.col("n") == 2, F.col("d_2")).otherwise(F.col("d_3"))
    marked = grams.join(seen.select("lang", "n_all", *discounts), "lang").select(
        "lang", "gram", "n", "n_all", F.shiftright("gram", SYMBOL_BITS).alias("context"), cut.alias("cut"))
    contexts = marked.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    found = marked.join(contexts, ["lang", "context"])
    if below is None:
        found = found.withColumn("p_below", 1 / F.col("n_all"))
    else:
        low = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * (order - 1)) - 1).cast("long"))
        found = found.withColumn("low", low).join(
            below.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_below")), ["lang", "low"])
    return found.select("lang", "gram", "n", ((F.col("n") - F.col("cut")) / F.col("total")
                                              + F.col("left") / F.col("total") * F.col("p_below")).alias("p"))


def model(docs: DataFrame) -> DataFrame:
    """``(lang, code, n, log_p)`` of every trigram of the texts: how often it occurs, and the log10 probability of its last
    character after the two before it. Lower orders count the different characters seen before an n-gram."""
    grams = {3: cut_lineage(count_trigrams(docs)).withColumnRenamed("code", "gram")}
    for order in (2, 1):
        low = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1).cast("long"))
        grams[order] = grams[order + 1].groupBy("lang", low.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    below = None
    for order in (1, 2, 3):
        below = _smoothed(grams[order], below, order)
    return cut_lineage(below.select("lang", F.col("gram").alias("code"), "n", F.log10("p").alias("log_p")))


@dataclass
class HashArrays:
    """Sorted hashes of n-grams with a log10 probability each, and of contexts with a log10 back-off weight."""

    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    back_off: list[np.ndarray]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(keys) == 0:
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at].astype(np.float64)

    def log10_p(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each trigram after the two before it."""
        out, open_, weight = np.zeros(len(code)), np.ones(len(code), bool), np.zeros(len(code))
        for order in (3, 2, 1):
            gram = code % SYMBOLS ** order
            found, value = self._find(self.grams[order - 1], self.log_p[order - 1], _hashed(order, gram))
            now = open_ & found
            out[now] = weight[now] + value[now]
            open_ &= ~found
            has, more = self._find(self.contexts[order - 1], self.back_off[order - 1], _hashed(order, gram // SYMBOLS))
            weight += np.where(has, more, 0.0)
        out[open_] = weight[open_] - np.log10(SYMBOLS)
        return out


def _hashed(order: int, gram: np.ndarray) -> np.ndarray:
    return _mix(gram.astype(np.uint64) + (np.uint64(order) << np.uint64(32)))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, and 3 or more; 0.5, 1, 1.5 where too few n-grams are seen."""
    n = [float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(found, [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])])


def smooth(code: np.ndarray, n: np.ndarray) -> HashArrays:
    """The model of one language over SYMBOLS symbols from its trigram counts, in memory and with back-off weights for
    n-grams never seen: what ``model`` does for all languages and code points.

    Lower orders count the different symbols seen before an n-gram; each order is interpolated with the next lower one.
    """
    orders = {3: (code, n.astype(np.float64))}
    for order in (2, 1):
        seen, different = np.unique(orders[order + 1][0] % SYMBOLS ** order, return_counts=True)
        orders[order] = (seen, different.astype(np.float64))
    lower_p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    lower_at = np.arange(SYMBOLS)
    grams, log_p, contexts, back_off = [], [], [], []
    for order in (1, 2, 3):
        seen, counts = orders[order]
        size = SYMBOLS ** (order - 1)
        discount = _discounts(counts)[np.minimum(counts, 3).astype(int)]
        context = seen // SYMBOLS
        total = np.bincount(context, counts, minlength=size)
        left = np.bincount(context, discount, minlength=size)
        used = np.flatnonzero(total)
        gamma = left[used] / total[used]
        below = lower_p[np.searchsorted(lower_at, seen % SYMBOLS ** max(order - 1, 1))]
        p = (counts - discount) / total[context] + left[context] / total[context] * below
        for keys, values, to, to_values in ((_hashed(order, seen), p, grams, log_p),
                                            (_hashed(order, used), gamma, contexts, back_off)):
            by_hash = np.argsort(keys)
            to.append(keys[by_hash])
            to_values.append(np.log10(np.maximum(values[by_hash], 1e-12)).astype(np.float32))
        lower_at, lower_p = seen, p
    return HashArrays(grams, log_p, contexts, back_off)


def most_frequent(trigram_model: DataFrame, held: int = HELD) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], int]:
    """Per language sorted codes and log10 probabilities of the trigrams that occur at least so often that there are no
    more than ``held`` of them, and that number of times; 1 if those are all."""
    powers = trigram_model.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).agg(
        F.count(F.lit(1)).alias("grams")).orderBy(F.desc("power")).collect()  # at most 63 rows
    least, total = 1 << 62, 0
    for row in powers:
        total += row["grams"]
        if total > held:
            break
        least = 1 << row["power"]
    table = trigram_model.filter(F.col("n") >= F.lit(least)).select("lang", "code", "log_p").toArrow()
    out = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang)).sort_by("code")
        out[lang] = own["code"].to_numpy(), own["log_p"].to_numpy()
    return out, 1 if total <= held else least


def repeated_words(found) -> np.ndarray:
    """Per text the words in 3-word windows that occur twice or more in it."""
    own, text = found.hashes(), found.text_of()
    covered = np.zeros(len(own), bool)
    if len(own) > 2:
        windows = np.flatnonzero(text[2:] == text[:-2])
        keys = combine(own[windows], own[windows + 1], own[windows + 2], text[windows])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[windows[twice] + k] = True
    return sum_per_text(covered, found.per_text).astype(np.int64)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    full = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(full) - len(set(full))


def measure(docs: DataFrame, trigram_model: DataFrame, held: int = HELD) -> DataFrame:
    """Word and symbol counts of every row, and the mean log10 perplexity per character (null without a character) by the
    ``model`` of the same texts.

    Trigrams that the tasks do not hold come out as lists, are joined to the model and added up per row. Each of them occurs
    less often than any that is held, so none is a hot key.
    """
    frequent, least = most_frequent(trigram_model, held)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")

    def batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0)
        for batch in arrow:
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = batch.filter(pc.equal(langs, lang))
                for row, data, offsets in slices(own.column(2)):
                    yield _measured(own.slice(row, len(offsets) - 1), data, offsets, *shared.value.get(lang, none))

    counted = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = rows.mapInArrow(batches, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines "
                                     "long, n_repeat_words long, chars long, log_p double, rest array<long>")
    if least > 1:
        found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
        rest = found.select("row", "lang", F.explode("rest").alias("code")).groupBy("row", "lang", "code").agg(
            F.count(F.lit(1)).alias("times")).join(
            trigram_model.filter(F.col("n") < F.lit(least)).select("lang", "code", F.col("log_p").alias("rest_p")),
            ["lang", "code"])
        rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("rest_p")).alias("rest_p"))
        found = found.join(rest, "row", "left").withColumn("log_p", F.col("log_p") + F.coalesce("rest_p", F.lit(0.0)))
    return found.select(*counted, (-F.try_divide("log_p", "chars")).alias("log_ppl"))


def _measured(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, known: np.ndarray,
              log_p: np.ndarray) -> pa.RecordBatch:
    found = words(data, offsets)
    inside = ((data & 0xC0) != 0x80) & ~IS_SPACE[data]
    codes, per_text = trigrams(data, offsets)
    different, place = np.unique(codes, return_inverse=True)
    is_held, value = HashArrays._find(known, log_p, different)
    is_rest = ~is_held[place]
    rest = np.concatenate(([0], np.cumsum(is_rest)))[per_text].astype(np.int32)
    lines = [duplicate_lines(t) for t in rows.column(2).to_pylist()]
    columns = [np.diff(found.per_text), sum_per_text(inside, offsets), sum_per_text(IS_SIGN[data], offsets),
               np.array(lines), repeated_words(found), np.diff(per_text)]
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), *[pa.array(c.astype(np.int64)) for c in columns],
         pa.array(sum_per_text(np.where(is_held, value, 0.0)[place], per_text)),
         pa.ListArray.from_arrays(pa.array(rest), pa.array(codes[is_rest]))],
        ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "log_p", "rest"])


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """``(lang, lowest, highest)``: the median of a language's log perplexities and ``width`` robust deviations about it.

    Texts that fail the base rules say nothing about a language and are left out, unless a language has no others.
    """
    failed = F.max((~F.col("base_failed")).cast("int"))
    judged = measured.filter(F.col("log_ppl").isNotNull())
    cells = judged.groupBy("lang", "base_failed", F.round(F.col("log_ppl") / STEP).cast("long").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"))
    clean = judged.groupBy("lang").agg(failed.alias("has_clean"))
    cells = cells.join(clean, "lang").filter((F.col("has_clean") == 0) | ~F.col("base_failed")).groupBy("lang", "cell").agg(
        F.sum("n").alias("n"))

    def limits(key: tuple, table: pa.Table) -> pa.Table:
        cell, n = table["cell"].to_numpy(), table["n"].to_numpy()

        def median(values: np.ndarray) -> float:
            order = np.argsort(values)
            return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

        middle = median(cell)
        spread = max(1.4826 * median(np.abs(cell - middle)), 1.0)
        return pa.table({"lang": [key[0].as_py()], "lowest": [(middle - width * spread) * STEP],
                         "highest": [(middle + width * spread) * STEP]})

    return cells.groupBy("lang").applyInArrow(limits, "lang string, lowest double, highest double")


def judge(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """Counts, ``base_failed``, ``log_ppl``, the band and ``kept`` of every row of ``docs``.

    A null text has no words, so the base rules reject it; a null ``lang`` is a language of its own; a null ``doc_id`` is
    judged like others; repeated rows give repeated results and count as often; an empty table gives an empty result.
    """
    measured = measure(docs, model(docs)).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    measured = cut_lineage(measured)
    found = measured.join(cut_lineage(bands(measured, width)), "lang", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("lowest"), F.col("highest")), F.lit(True))
    return found.withColumn("kept", ~F.col("base_failed") & inside)


def report(docs: DataFrame) -> DataFrame:
    """The result of ``op1_perplexity``."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                              "kept", "lang", "log_ppl", "lowest", "highest")
