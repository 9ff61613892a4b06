"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A word belongs to a class by its last two bytes; the end of a text is a class of its own. The class of the next token is a
softmax over hashed features of the tokens before it (the last word, the last pair, a skip over one word, and the last
three classes). Inside its class a second softmax over the same features chooses one of the class's most frequent training
words, or the rest; a word of the rest has its smoothed share of the rest's training tokens.

Blocks of documents learn by gradient steps, each from the weights merged before it: a first block alone, then four times
as many blocks in each round, so that more text gives more rounds. The last round's merged weights score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import LOWER, combine, previous, slices, sum_per_text, words

CLASSES = 16
END_CLASS = CLASSES - 1
END = np.uint64(0x656E64)
# Outcomes inside a class: its most frequent words, and the rest as the last one.
MEMBERS = 32
REST = MEMBERS - 1
KINDS, CLASS_BITS, MEMBER_BITS = 4, 13, 10
BATCH, RATE = 1 << 14, 0.5
# Rows of a batch whose gradients are added up each by itself, at most.
LONG_ROWS = 64
SMOOTHING = 0.1
# Bytes of text of a block, in the mean: what one task learns from, and how many times more blocks the next round has.
BLOCK_BYTES, GROWTH = 24 << 20, 4
# Weights of one message, and words that a task counts before it hands them on.
MESSAGE, COUNTED = 1 << 15, 1 << 21


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, each text closed by an end, and where the tokens of each text begin."""
    found = words(LOWER[data], offsets)
    n, texts = len(found.starts), len(offsets) - 1
    at = np.arange(n) + found.text_of()
    begins = found.per_text + np.arange(texts + 1)
    hashed, kind = np.full(n + texts, END, np.uint64), np.full(n + texts, END_CLASS, np.int64)
    if n:
        own = found.hashes()
        hashed[at] = np.where(own == END, own + np.uint64(1), own)
        last = found.data[found.ends - 1].astype(np.uint64)
        second = np.where(found.ends - found.starts > 1, found.data[np.maximum(found.ends - 2, 0)], 0).astype(np.uint64)
        kind[at] = (combine(last, second) % np.uint64(END_CLASS)).astype(np.int64)
    return hashed, kind, begins


def contexts(hashed: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``[feature kind, token]`` hashes of the features of what comes before each token."""
    one, two = previous(hashed, begins, 1), previous(hashed, begins, 2)
    k1, k2, k3 = (previous(kind, begins, k, END_CLASS).astype(np.uint64) for k in (1, 2, 3))
    classes = (k1 * np.uint64(CLASSES) + k2) * np.uint64(CLASSES) + k3 + np.uint64(1)
    features = (one, two + np.uint64(0x9E3779B97F4A7C15) * one, two, classes)
    return np.stack([f * np.uint64(0xD1B54A32D192ED03) for f in features])


def _sums(table: np.ndarray) -> np.ndarray:
    """The sum of each row; a product with ones is far quicker than a reduction of short rows."""
    return table @ np.ones(table.shape[1], table.dtype)


class Softmax:
    """One factor: a row of weights per slot of each feature kind and a last one for the bias, an outcome per column.

    The rate of a row falls with the sum of its squared gradients.
    """

    def __init__(self, outcomes: int, bits: int) -> None:
        self.bits, rows = bits, (KINDS << bits) + 1
        self.weights, self.squares = np.zeros((rows, outcomes), np.float32), np.ones(rows, np.float32)

    def rows(self, features: np.ndarray) -> np.ndarray:
        slots = (features >> np.uint64(64 - self.bits)).astype(np.int64) + (np.arange(KINDS) << self.bits)[:, None]
        # Two bytes, which numpy sorts by radix.
        return slots.astype(np.uint16)

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        """``[token, outcome]`` sums of weights, the greatest of each token being 0."""
        logits = self.weights.take(rows[0], 0)
        for own in rows[1:]:
            logits += self.weights.take(own, 0)
        logits += self.weights[-1]
        logits -= np.ascontiguousarray(logits.T).max(0)[:, None]
        return logits

    def log_p(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each token's outcome."""
        logits = self._logits(rows)
        own = logits[np.arange(len(target)), target]
        return own - np.log(_sums(np.exp(logits, out=logits)))

    def learn(self, rows: np.ndarray, target: np.ndarray) -> None:
        """One gradient step for a batch of tokens."""
        gradient = self._logits(rows)
        np.exp(gradient, out=gradient)
        gradient /= _sums(gradient)[:, None]
        gradient[np.arange(len(target)), target] -= 1.0
        # All feature kinds at once: their rows differ.
        order = np.argsort(rows.ravel(), kind="stable")
        by_row = rows.ravel()[order]
        heads = np.flatnonzero(np.concatenate(([True], by_row[1:] != by_row[:-1])))
        at = np.append(by_row[heads].astype(np.int64), len(self.squares) - 1)
        # One place after the other of all rows, until those that go on are few and long.
        token, sizes = order % len(target), np.diff(np.append(heads, len(order)))
        sums = gradient.take(token[heads], 0)
        more = np.flatnonzero(sizes > 1)
        place = 1
        while len(more) > LONG_ROWS:
            sums[more] += gradient.take(token[heads[more] + place], 0)
            place += 1
            more = more[sizes[more] > place]
        for k in more.tolist():
            sums[k] += gradient.take(token[heads[k] + place:heads[k] + sizes[k]], 0).sum(0)
        sums = np.concatenate((sums, _sums(gradient.T)[None]))
        self.squares[at] += np.einsum("ij,ij->i", sums, sums)
        self.weights[at] -= sums * (RATE / np.sqrt(self.squares[at]))[:, None]


class Model:
    """The softmax of classes, and for every class but the end's the softmax of its members."""

    def __init__(self, values: np.ndarray | None = None) -> None:
        self.classes = Softmax(CLASSES, CLASS_BITS)
        self.members = [Softmax(MEMBERS, MEMBER_BITS) for _ in range(END_CLASS)]
        at = 0
        for own in (self.classes, *self.members) if values is not None else ():
            n, m = own.weights.size, len(own.squares)
            own.weights = values[at:at + n].reshape(own.weights.shape).astype(np.float32)
            own.squares = np.exp2(values[at + n:at + n + m], dtype=np.float32)
            at += n + m

    def flat(self) -> np.ndarray:
        """All weights and, as powers of two, the sums of squares, in half precision."""
        parts = [(own.weights.ravel(), np.log2(own.squares)) for own in (self.classes, *self.members)]
        return np.concatenate([x for part in parts for x in part]).astype(np.float16)

    @staticmethod
    def _by_class(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES))
        for c in range(END_CLASS):
            if ends[c] < ends[c + 1]:
                yield c, order[ends[c]:ends[c + 1]]

    def learn(self, features: np.ndarray, kind: np.ndarray, member: np.ndarray) -> None:
        for first in range(0, len(kind), BATCH):
            f, k, m = features[:, first:first + BATCH], kind[first:first + BATCH], member[first:first + BATCH]
            self.classes.learn(self.classes.rows(f), k)
            for c, at in self._by_class(k):
                self.members[c].learn(self.members[c].rows(f[:, at]), m[at])

    def log_p(self, features: np.ndarray, kind: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Log probability of each token's class and member."""
        out = np.zeros(len(kind))
        for first in range(0, len(kind), BATCH):
            f, k, m = features[:, first:first + BATCH], kind[first:first + BATCH], member[first:first + BATCH]
            part = self.classes.log_p(self.classes.rows(f), k).astype(np.float64)
            for c, at in self._by_class(k):
                part[at] += self.members[c].log_p(self.members[c].rows(f[:, at]), m[at])
            out[first:first + BATCH] = part
        return out


class Frequent:
    """The words that are members of their class, by hash."""

    def __init__(self, hashed: np.ndarray, kind: np.ndarray, member: np.ndarray) -> None:
        order = np.argsort(hashed)
        self.hashed, self.kind, self.member = hashed[order], kind[order], member[order]

    def members(self, hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.hashed):
            return np.full(len(hashed), REST)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        return np.where((self.hashed[at] == hashed) & (self.kind[at] == kind), self.member[at], REST)


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their block, and the number of blocks. Rows that share id and text share a block."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.withColumn("held_out", held_out()).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text"), F.lit(blocks))), blocks


def rounds(blocks: int) -> list[tuple[int, int]]:
    """First block and end of each round; the last round has all but one in GROWTH, the one before it so much of the rest."""
    out = [blocks]
    while out[0] > 0:
        out.insert(0, out[0] // GROWTH)
    return list(zip(out[:-1], out[1:]))


def count_tokens(keyed: DataFrame) -> DataFrame:
    """``(hash, class, count)`` of all tokens, ``count`` of them in training rows, added up inside each task first."""
    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        hashed, kind, n = (np.concatenate(x) for x in zip(*parts))
        own, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        return own, kind[first], np.bincount(inverse, n, minlength=len(own)).astype(np.int64)

    def rows(own: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(own[0]), 1 << 16):
            hashed, kind, n = (x[at:at + (1 << 16)] for x in own)
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)],
                                             ["hash", "class", "n"])

    def batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in arrow:
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in slices(batch.column(0)):
                hashed, kind, begins = tokens(data, offsets)
                held.append(added([(hashed, kind, np.repeat(train[row:row + len(offsets) - 1], np.diff(begins)))]))
                if sum(len(x[0]) for x in held) > COUNTED:
                    held = [added(held)]
                    if len(held[0][0]) > COUNTED // 2:
                        yield from rows(held.pop())
        if held:
            yield from rows(added(held))

    return keyed.select("text", "held_out").mapInArrow(batches, "hash long, class int, n long").groupBy("hash").agg(
        F.sum("n").alias("count"), F.max("class").alias("class"))


def learn_blocks(keyed: DataFrame, frequent: Frequent, start) -> DataFrame:
    """One pass over every block from the weights that the broadcast ``start`` holds: ``(block, hash)`` of its words, and its
    weights as rows ``(block, first weight, n, payload)`` with ``n`` training tokens."""
    schema = "block long, hash long, n long, payload binary"

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        train = ~table["held_out"].to_numpy()
        model, parts, learned = Model(start.value), [], 0
        for row, data, offsets in slices(table["text"]):
            hashed, kind, begins = tokens(data, offsets)
            use = np.repeat(train[row:row + len(offsets) - 1], np.diff(begins))
            model.learn(contexts(hashed, kind, begins)[:, use], kind[use], frequent.members(hashed[use], kind[use]))
            learned += int(use.sum())
            parts.append(np.unique(hashed))
        own, weights = np.unique(np.concatenate(parts)), model.flat()
        sent = range(0, len(weights), MESSAGE)
        return pa.table({
            "block": pa.array(np.full(len(own) + len(sent), key[0].as_py(), np.int64)),
            "hash": pa.array(np.concatenate((own.view(np.int64), sent))),
            "n": pa.array(np.repeat([0, learned], [len(own), len(sent)])),
            "payload": pa.array([None] * len(own) + [weights[at:at + MESSAGE].tobytes() for at in sent], pa.binary())})

    return keyed.groupBy("block").applyInArrow(block, schema)


def average(learned: DataFrame) -> np.ndarray | None:
    """The blocks' weights averaged by their training tokens; the driver sees the average only."""
    sent = learned.filter("payload IS NOT NULL AND n > 0")

    def added(batches: Iterator[pa.RecordBatch], of: type, by_tokens: bool) -> tuple[np.ndarray | float, int]:
        total, n = 0.0, 0
        for batch in batches:
            for payload, own in zip(batch.column("payload"), batch.column("n").to_pylist()):
                values = np.frombuffer(payload.as_buffer(), of).astype(np.float64)
                total, n = total + values * (own if by_tokens else 1), n + own
        return total, n

    def part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = added(batches, np.float16, True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n]), pa.array([total.tobytes()], pa.binary())],
                                         ["hash", "n", "payload"])

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = added(batches, np.float64, False)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())],
            ["hash", "payload"])

    # A second key spreads a message over tasks before its parts are added up.
    lanes = sent.withColumn("lane", F.pmod("block", F.lit(64))).groupBy("hash", "lane").applyInArrow(
        part, "hash long, n long, payload binary")
    merged = lanes.groupBy("hash").applyInArrow(whole, "hash long, payload binary")
    parts = {row["hash"]: np.frombuffer(bytes(row["payload"]), np.float32) for row in merged.toLocalIterator()}
    return np.concatenate([parts[at] for at in sorted(parts)]) if parts else None


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    The model learns from the rows that are not held out. A null text counts as empty and has its end as only token; a null
    ``doc_id`` is a training row; repeated rows count and are scored each; an empty table gives an empty result. Very long
    texts are read whole, in one block. Tokens unknown to training get the share that smoothing leaves to the rest of their
    class. Words that are equally frequent become members in the order of their hashes.
    """
    keyed, blocks = _keyed(docs)
    context = docs.sparkSession.sparkContext
    totals = cut_lineage(count_tokens(keyed))
    per_class = totals.groupBy("class").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).collect()
    n_all, v_all = sum(row["n"] for row in per_class), sum(row["v"] for row in per_class)
    n_rest, v_rest = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in per_class:  # one row per class
        n_rest[row["class"]], v_rest[row["class"]] = row["n"], row["v"]
    by_count = Window.partitionBy("class").orderBy(F.desc("count"), "hash")
    top = (totals.filter((F.col("count") > 0) & (F.col("class") < END_CLASS)).withColumn("place", F.row_number().over(by_count))
           .filter(F.col("place") < MEMBERS).collect())  # fewer than CLASSES * MEMBERS rows
    frequent = Frequent(np.array([r["hash"] for r in top], np.int64).view(np.uint64),
                        np.array([r["class"] for r in top], np.int64), np.array([r["place"] - 1 for r in top], np.int64))
    for row in top:
        n_rest[row["class"]] -= row["count"]
        v_rest[row["class"]] -= 1

    weights, tables = None, []
    for first, end in rounds(blocks):
        own = keyed.filter(F.col("block").between(first, end - 1))
        tables.append(cut_lineage(learn_blocks(own, frequent, context.broadcast(weights))))
        merged = average(tables[-1])
        weights = weights if merged is None else merged
    seen = tables[0]
    for more in tables[1:]:
        seen = seen.unionByName(more)
    shared = context.broadcast(weights)
    known = seen.filter("payload IS NULL").select("block", "hash").join(totals.select("hash", "count"), "hash")

    def block(key: tuple, texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        model = Model(shared.value)
        names = vocabulary["hash"].to_numpy().view(np.uint64)
        order = np.argsort(names)
        names, counts = names[order], vocabulary["count"].to_numpy()[order].astype(np.float64)
        out = []
        for row, data, offsets in slices(texts["text"]):
            hashed, kind, begins = tokens(data, offsets)
            c = counts[np.searchsorted(names, hashed)]
            member = frequent.members(hashed, kind)
            in_rest = np.log10((c + SMOOTHING) / (n_rest + SMOOTHING * (v_rest + 1))[kind])
            base = np.log10((c + SMOOTHING) / (n_all + SMOOTHING * (v_all + 1)))
            own = model.log_p(contexts(hashed, kind, begins), kind, member) / np.log(10)
            own += np.where((member == REST) & (kind != END_CLASS), in_rest, 0.0)
            out.append((np.diff(begins), sum_per_text(c > 0, begins), sum_per_text(base, begins), sum_per_text(own, begins)))
        n_tokens, n_known, base, own = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 4
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(n_tokens.astype(np.int64)),
                         "n_known": pa.array(n_known.astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(base), int(n_all))),
                         "base_score": pa.array(base), "score": pa.array(own)})

    return keyed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double")


def report(docs: DataFrame) -> DataFrame:
    """The result of ``op9_maxent``."""
    return score(docs)
