"""Quality by hashed word n-grams: logistic regression trained with follow-the-regularised-leader updates.

Features of a text are the hashes of its words and word pairs, and of the pairs and triples of its word shapes (letters,
capitals, digits and signs, runs written once; ``=`` for a word that repeats the one before). Counts are dampened and the
vector is scaled to length one, so long and short texts get comparable scores.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import LOWER, combine, previous, slices, words

# Slots of the weight table; this bounds the model, which every task gets.
SLOTS = 1 << 18
# Labelled rows to fit on, at most; which ones is drawn by a hash of the id.
MOST_ROWS = 20_000
EPOCHS = 3
# Learners that see disjoint rows; their weights are averaged.
LEARNERS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
ACCEPT = 0.7

# Byte classes for shapes: letter, capital, digit, other byte above 127 (letters of other scripts), signs as themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed slots, values and the place where each text begins among them."""
    raw = words(data, offsets)
    lower = words(LOWER[data], offsets)
    own = lower.hashes()
    per_text = lower.per_text
    shape = _shapes(raw)
    before = previous(own, per_text, 1)
    shape = np.where((own == before) & (before != 0), np.uint64(61), shape)
    shape1, shape2 = previous(shape, per_text, 1), previous(shape, per_text, 2)
    hashed = np.stack([combine(1, own), combine(2, before, own), combine(3, shape1, shape), combine(4, shape2, shape1, shape),
                       combine(5, shape)], 1) if len(own) else np.zeros((0, 5), np.uint64)
    slots = (hashed % np.uint64(SLOTS)).astype(np.int64).ravel()
    text = np.repeat(lower.text_of(), 5)
    keys, counts = np.unique(text * SLOTS + slots, return_counts=True)
    values = 1.0 + np.log(counts)
    text, slots = keys // SLOTS, keys % SLOTS
    begins = np.searchsorted(text, np.arange(len(offsets)))
    norm = np.sqrt(np.bincount(text, values * values, minlength=len(offsets) - 1))
    return slots, values / norm[text], begins


def _shapes(found) -> np.ndarray:
    """A hash of each word's shape, in which a run of one byte class counts once."""
    if len(found.starts) == 0:
        return np.zeros(0, np.uint64)
    classes = SHAPE[found.data]
    fresh = np.ones(len(classes), bool)
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[found.starts] = True
    lengths = found.ends - found.starts
    begin = np.cumsum(lengths) - lengths
    at = np.repeat(found.starts, lengths) + (np.arange(int(lengths.sum())) - np.repeat(begin, lengths))
    kept = fresh[at]
    place = np.cumsum(kept)
    place = place - np.repeat(place[begin] - 1, lengths)
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
    return combine(np.add.reduceat(np.where(kept, powers[place] * (classes[at].astype(np.uint64) + np.uint64(7)), 0),
                                   begin, dtype=np.uint64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Weights of one learner; slot SLOTS is the bias and is not regularised."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        slots, values = np.append(slots, SLOTS), np.append(values, 1.0)
        w = self.weights(slots)
        g = (float(sigmoid(np.array(w @ values))) - label) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def train(labelled: DataFrame, label: str = "label", most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights learned from rows ``(doc_id, text, label)``.

    At most about ``most_rows`` of the rows with a label 0 or 1 are used, chosen by a hash of the id alone. LEARNERS tasks
    read them in hash order, EPOCHS times, and their weights are averaged slot by slot; the driver sees one number per slot.
    """
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")), F.lit(1 << 30))
    rows = rows.filter(draw < int((1 << 30) * min(1.0, most_rows / max(n, 1))))
    rows = rows.select(draw.alias("draw"), F.col(label).cast("double").alias("label"), "text",
                       F.pmod(draw, F.lit(LEARNERS)).alias("learner"))

    def learn(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("label", "ascending")])
        labels = table["label"].to_numpy()
        found = []
        for row, data, offsets in slices(table["text"]):
            slots, values, begins = features(data, offsets)
            found += [(slots[a:b].astype(np.int32), values[a:b].astype(np.float32), labels[row + i])
                      for i, (a, b) in enumerate(zip(begins[:-1], begins[1:]))]
        model = Ftrl()
        for _ in range(EPOCHS):
            for slots, values, y in found:
                model.learn(slots, values.astype(np.float64), y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pa.table({"slot": at, "w": w[at] * len(found), "rows": np.full(len(at), float(len(found)))})

    parts = cut_lineage(rows.groupBy("learner").applyInArrow(learn, "slot long, w double, rows double"))
    seen = parts.filter(F.col("slot") == SLOTS).agg(F.sum("rows")).first()[0]
    summed = parts.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()
    weights = np.zeros(SLOTS + 1)
    if seen:
        weights[summed["slot"].to_numpy(dtype=np.int64)] = summed["w"].to_numpy() / seen
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` per row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in rows:
            scores = np.zeros(batch.num_rows)
            for row, data, offsets in slices(batch.column(1)):
                slots, values, begins = features(data, offsets)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
                dots = np.bincount(text, w[slots] * values, minlength=len(offsets) - 1)
                scores[row:row + len(offsets) - 1] = sigmoid(dots + w[SLOTS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled documents that are not held out. A document with several labels counts once for each."""
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return train(known.join(texts, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    A null text is scored as an empty one, whose score is the bias alone; a null ``doc_id`` is scored and not held out;
    repeated rows give repeated results. Labels other than 0 and 1 are left out; without any label every score is 0.5.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality 1. Rows without an id are not judged and stay."""
    poor = classify(docs, labels).filter("predicted = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(poor, "doc_id", "left_anti").select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of ``op10_quality_classifier``."""
    return classify(docs, labels)
