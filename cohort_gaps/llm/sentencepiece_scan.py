"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The pieces and scores of the model file are read as a unigram model: the best segmentation has the largest sum of scores.
Ordinary texts are encoded whole. A giant text is cut into chunks; the state at a border is how many characters the piece
across it reaches into the next chunk. Each chunk yields a matrix of best scores from entry to exit state, matrices combine
associatively under (max, +), and with its entry and exit known each chunk is traced back on its own.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import _mix

# Texts with more characters are scanned in chunks of CHUNK characters.
GIANT, CHUNK = 1 << 16, 1 << 13
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LAST_RESORT = -1e8
UNKNOWN = -1
NONE = -np.inf
# Chunks whose matrices are computed together.
TOGETHER = 32


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # unigram
    # A score of -1e9 marks a last resort; beside it single precision would not tell other scores apart.
    least = min(p.score for p in proto.pieces if p.score > LAST_RESORT)
    for piece in proto.pieces:
        if piece.score <= LAST_RESORT:
            piece.score = least - 1
    return proto


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's encoder for the same pieces and scores."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=_proto(path).SerializeToString())


class Pieces:
    """Pieces as arrays sorted by a hash of their characters, by length, and their bytes for decoding."""

    def __init__(self, path: str) -> None:
        proto = _proto(path)
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL]
        self.longest = max(len(p) for _, p, _ in normal)
        self.unknown = min(s for _, _, s in normal) - UNKNOWN_PENALTY
        self.tables = []
        for size in range(1, self.longest + 1):
            own = [(i, p, s) for i, p, s in normal if len(p) == size]
            code = np.array([[ord(c) for c in p] for _, p, _ in own], np.uint64).reshape(len(own), size)
            keys = self._hashed([code[:, k] for k in range(size)], len(own))
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array([i for i, _, _ in own], np.int32)[order],
                                np.array([s for _, _, s in own], np.float64)[order]))
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            else:
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode() if p.type == p.NORMAL else b"")

    @staticmethod
    def _hashed(columns: list[np.ndarray], rows: int) -> np.ndarray:
        out = np.zeros(rows, np.uint64)
        for column in columns:
            out = _mix(out * np.uint64(0x100000001B3) + column.astype(np.uint64) + np.uint64(1))
        return out

    def lattice(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``[place, length - 1]`` scores and ids of the pieces that begin at each place; NONE where there is none.

        A character that is no piece by itself is an unknown edge. Places past the end hold no piece.
        """
        n = len(code)
        padded = np.concatenate((code.astype(np.uint64), np.full(self.longest, 1 << 32, np.uint64)))
        scores = np.full((n, self.longest), NONE)
        ids = np.full((n, self.longest), UNKNOWN, np.int32)
        hashed = np.zeros(n, np.uint64)
        for k, (keys, own, value) in enumerate(self.tables):
            hashed = _mix(hashed * np.uint64(0x100000001B3) + padded[k:k + n] + np.uint64(1))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                hit = keys[at] == hashed
                scores[hit, k], ids[hit, k] = value[at[hit]], own[at[hit]]
        scores[:, 0] = np.where(ids[:, 0] == UNKNOWN, self.unknown, scores[:, 0])
        return scores, ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def transfer(scores: np.ndarray, chunk: int, states: int) -> np.ndarray:
    """``[chunk, entry, exit]`` best scores; ``scores`` is ``[chunk, place, length - 1]`` of ``chunk`` places each.

    Entry ``a`` starts at place ``a``; exit ``b`` is the first border at or after the end, ``b`` characters past it.
    """
    many, longest = scores.shape[0], scores.shape[2]
    best = np.full((chunk + states, many, states), NONE)
    for place in range(chunk + states):
        if place < states:
            best[place, :, place] = 0.0 if place < chunk else NONE
        for size in range(1, min(longest, place) + 1):
            start = place - size
            if start < chunk:
                np.maximum(best[place], best[start] + scores[:, start, size - 1][:, None], out=best[place])
    # A piece may reach over a whole short chunk: such an entry is its own exit.
    for a in range(chunk, states):
        best[a, :, a] = np.maximum(best[a, :, a], 0.0)
    return np.moveaxis(best[chunk:chunk + states], 0, 2)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices."""
    return (left[:, :, None] + right[None, :, :]).max(1)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at every border of the best path from state 0 to state 0, both ends included.

    Prefix products run forward by doubling; the borders are then read off backward.
    """
    prefix = list(matrices)
    step = 1
    while step < len(prefix):
        prefix = [combine(prefix[k - step], m) if k >= step else m for k, m in enumerate(prefix)]
        step *= 2
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefix[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]]


def trace(scores: np.ndarray, ids: np.ndarray, code: np.ndarray, chunk: int, entry: int, exit_: int,
          model: Pieces) -> list[int]:
    """The ids of one chunk's best path from its entry to its exit."""
    end = chunk + exit_
    best, back = np.full(end + 1, NONE), np.zeros(end + 1, np.int64)
    best[entry] = 0.0
    longest = scores.shape[1]
    for place in range(entry + 1, end + 1):
        low = max(entry, place - longest)
        starts = np.arange(low, min(place, chunk))
        if len(starts):
            value = best[starts] + scores[starts, place - starts - 1]
            pick = int(np.argmax(value))
            best[place], back[place] = value[pick], starts[pick]
    out, place = [], end
    while place > entry:
        start = int(back[place])
        piece = int(ids[start, place - start - 1])
        if piece == UNKNOWN:
            out.extend(model.byte_ids[b] for b in reversed(chr(int(code[start])).encode("utf-8")))
        else:
            out.append(piece)
        place = start
    return out[::-1]


def _normal(text: str) -> np.ndarray:
    marked = (SPACE + text.replace(" ", SPACE)) if text else ""
    return np.frombuffer(marked.encode("utf-32-le"), np.uint32)


def scan_encode(path: str, text: str, chunk: int = CHUNK) -> list[int]:
    """The ids of one text by the scan, in this process; what the Spark job does chunk by chunk."""
    model, code = pieces(path), _normal(text)
    if not len(code):
        return []
    states = model.longest
    scores, ids = model.lattice(code)
    cuts = list(range(0, len(code), chunk))
    sizes = [min(chunk, len(code) - c) for c in cuts]
    matrices = [transfer(scores[c:c + n][None], n, states)[0] for c, n in zip(cuts, sizes)]
    borders = border_states(matrices)
    out: list[int] = []
    for k, (c, n) in enumerate(zip(cuts, sizes)):
        out += trace(scores[c:c + n], ids[c:c + n], code[c:c + n], n, borders[k], borders[k + 1], model)
    return out


def decode(path: str, ids: list[int] | np.ndarray) -> str:
    """The text of ids; bytes that are no text become the replacement character, as in the library."""
    table = pieces(path).bytes_of
    raw = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


CHUNKS = "row long, chunk_no int, last boolean, code binary, ahead int"


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, text, ids)`` per row of ``docs``; ``ids`` are little-endian 32-bit words.

    A null text has no ids and stays null, an empty one has none; a null ``doc_id`` is carried along; repeated rows are
    encoded each; an empty table gives an empty result. Only texts of more than ``giant`` characters take the scan, whose
    chunks are spread over tasks; a task holds TOGETHER chunks at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.coalesce(F.char_length("text") > giant, F.lit(False))

    def whole(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = processor(path)
        for batch in arrow:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(_packed, ids), pa.binary())],
                                                 ["doc_id", "text", "ids"])

    ordinary = rows.filter(~long_).mapInArrow(whole, "doc_id long, text string, ids binary")
    large = cut_lineage(rows.filter(long_).withColumn("row", F.monotonically_increasing_id()))
    return ordinary.unionByName(_scanned(large, path, chunk))


def _scanned(large: DataFrame, path: str, chunk: int) -> DataFrame:
    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = pieces(path).longest - 1
        for batch in arrow:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = _normal(text)
                for no, at in enumerate(range(0, len(code), chunk)):
                    part = code[at:at + chunk + ahead]
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "chunk_no": no, "last": at + chunk >= len(code), "code": part.tobytes(),
                          "ahead": max(0, len(part) - chunk)}],
                        schema=pa.schema([("row", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
                                          ("code", pa.binary()), ("ahead", pa.int32())]))

    def lattices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        model = pieces(path)
        for code, ahead in zip(batch.column("code").to_pylist(), batch.column("ahead").to_pylist()):
            own = np.frombuffer(code, np.uint32)
            scores, ids = model.lattice(own)
            yield len(own) - ahead, scores, ids, own

    def matrices(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = pieces(path).longest
        for batch in arrow:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = list(lattices(part))
                done: list[bytes] = [b""] * len(found)
                for size in sorted({n for n, _, _, _ in found}):
                    same = [k for k, f in enumerate(found) if f[0] == size]
                    for k, m in zip(same, transfer(np.stack([found[k][1][:size] for k in same]), size, states)):
                        done[k] = m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("chunk_no"), pa.array(done, pa.binary())], ["row", "chunk_no", "matrix"])

    def borders(key: tuple, table: pa.Table) -> pa.Table:
        states = pieces(path).longest
        table = table.sort_by("chunk_no")
        found = border_states([np.frombuffer(m, np.float64).reshape(states, states) for m in table["matrix"].to_pylist()])
        return pa.table({"row": table["row"], "chunk_no": table["chunk_no"], "entry": pa.array(found[:-1], pa.int32()),
                         "exit": pa.array(found[1:], pa.int32())})

    def traced(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in arrow:
            out = []
            for (size, scores, ids, code), a, b in zip(lattices(batch), batch.column("entry").to_pylist(),
                                                       batch.column("exit").to_pylist()):
                out.append(_packed(trace(scores, ids, code, size, a, b, model)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk_no"), pa.array(out, pa.binary())],
                                             ["row", "chunk_no", "ids"])

    spread = F.xxhash64("row", "chunk_no")
    chunks = cut_lineage(large.select("row", "text").mapInArrow(cut, CHUNKS).repartition(spread))
    states = (chunks.select("row", "chunk_no", "code", "ahead").mapInArrow(matrices, "row long, chunk_no int, matrix binary")
              .groupBy("row").applyInArrow(borders, "row long, chunk_no int, entry int, exit int"))
    parts = (chunks.join(states, ["row", "chunk_no"]).select("row", "chunk_no", "code", "ahead", "entry", "exit")
             .mapInArrow(traced, "row long, chunk_no int, ids binary"))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        own = b"".join(table.sort_by("chunk_no")["ids"].to_pylist())
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([own], pa.binary())})

    whole = parts.groupBy("row").applyInArrow(joined, "row long, ids binary")
    return large.join(whole, "row").select("doc_id", "text", "ids")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text, ids, decoded)``: the text of the ids beside the one they were made from."""
    def batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode(path, np.frombuffer(ids, "<u4").tolist()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 ["doc_id", "text", "ids", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(batches,
                                                              "doc_id long, text string, ids binary, decoded string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """The result of ``op3_sentencepiece``: count and checksum of the ids, and whether decoding gives the text back."""
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded(encode(docs, path), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        same.alias("round_trip"))
