"""Bounded-space online packing of tokenised documents into sequences of at most 1024 tokens.

Each partition keeps a fixed number of open windows. A piece goes to the window it fills best; if it fits in none, the
fullest is topped up with the head of the piece and emitted. What stays open at the end is merged over partitions by the
same rule, and the last windows are cut at powers of two, so that nothing needs padding.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import encode_ids, portions

WINDOW = 1024
OPEN = 32
END_ID = 0
# Leftover windows that one merging task takes in the mean.
MERGED = 512
# A sequence number is round * 2^56 + task * 2^32 + count.
ROUND, TASK = 1 << 56, 1 << 32

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, "
          "open boolean")
NAMES = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "open"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]


class Windows:
    """Open windows of one task; ``out`` collects finished pieces."""

    def __init__(self, first_id: int, window: int = WINDOW, most: int = OPEN) -> None:
        self.next_id, self.window, self.most = first_id, window, most
        self.open: list[list] = []  # [used, pieces]
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple], still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, doc_tokens, ids, self.next_id, offset, still_open))
            offset += length
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        whole = len(ids) // 4 // self.window * self.window
        for at in range(0, whole, self.window):
            self._close([(doc_id, start + at, ids[4 * at:4 * (at + self.window)], doc_tokens)])
        start, ids = start + whole, ids[4 * whole:]
        size = len(ids) // 4
        if not size:
            return
        fits = [w for w in self.open if w[0] + size <= self.window]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            best = [0, []]
            self.open.append(best)
        else:
            fullest = max(self.open, key=lambda w: w[0])
            room = self.window - fullest[0]
            fullest[1].append((doc_id, start, ids[:4 * room], doc_tokens))
            self._close(fullest[1])
            start, ids, size = start + room, ids[4 * room:], size - room
            fullest[:] = [0, []]
            best = fullest
        best[0] += size
        best[1].append((doc_id, start, ids, doc_tokens))
        if best[0] == self.window:
            self._close(best[1])
            self.open.remove(best)

    def leave(self) -> None:
        """Hand the open windows on."""
        for _, pieces in self.open:
            if pieces:
                self._close(pieces, True)
        self.open = []

    def finish(self) -> None:
        """Close the open windows: join them into one row of tokens and cut it at powers of two, largest first."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        total = sum(len(p[2]) // 4 for p in rest)
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            room, taken = size, []
            while room:
                doc_id, start, ids, doc_tokens = rest.pop(0)
                length = len(ids) // 4
                if length > room:
                    rest.insert(0, (doc_id, start + room, ids[4 * room:], doc_tokens))
                    ids, length = ids[:4 * room], room
                taken.append((doc_id, start, ids, doc_tokens))
                room -= length
            self._close(taken)
            total -= size

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)`` of every row of ``docs``.

    ``ids`` are little-endian 32-bit words; each document is followed by END_ID. Every id of a row lies in one piece, and
    the pieces of a sequence fill it from offset 0 without a gap. A null text counts as empty and yields the end id; a null
    ``doc_id`` is carried along; repeated rows are packed once each; an empty table gives no pieces. ``window`` is a power
    of two. Tasks never hold more than ``most_open`` windows and one document.
    """
    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() * TASK, window, most_open)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in portions(texts):
                for doc_id, ids in zip(doc_ids[part], encode_ids(tokenizer_path, texts[part])):
                    windows.add(doc_id, 0, ids + end, len(ids) // 4 + 1)
                yield windows.flush()
        windows.leave()
        yield windows.flush()

    def merge(turn: int, last: bool):
        def group(key: tuple, table: pa.Table) -> pa.Table:
            windows = Windows(turn * ROUND + key[0].as_py() * TASK, window, most_open)
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                windows.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            windows.finish() if last else windows.leave()
            return pa.Table.from_batches([windows.flush()])

        return group

    pieces = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, SCHEMA))
    done, turn = [pieces.filter("NOT open")], 0
    rest = pieces.filter("open")
    while True:
        turn += 1
        # Few windows are left of each task, so a merging round shrinks their number by MERGED / most_open or more.
        groups = -(-rest.select("sequence_id").distinct().count() // MERGED)
        keyed = rest.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(max(groups, 1))))
        merged = cut_lineage(keyed.groupBy("group").applyInArrow(merge(turn, groups <= 1), SCHEMA))
        done.append(merged.filter("NOT open"))
        if groups <= 1:
            break
        rest = merged.filter("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")


def padded_length(length: Column, window: int = WINDOW) -> Column:
    """The length a sequence has after padding: itself at a power of two, else the window."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(window))


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The result of ``op4_packing``."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                             "sequence_id", "offset")
