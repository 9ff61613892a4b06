"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find, one line kept per component.

A line is what stands between line breaks, its ends trimmed. Two lines are near if the sets of their five-character
shingles (the whole line, if shorter) have a Jaccard similarity of at least 0.8. Blank lines are never duplicates.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage, scratch
from .text import PRIME, _mix, slices, words

SHINGLE = 5
THRESHOLD = 0.8
# A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 6) ** 16 = 0.992, one at 0.85 with 0.9997; lines
# with a tenth of their shingles in common do so once in 60,000 pairs, which matters because such pairs grow with the square
# of the input.
BANDS, ROWS = 16, 6
EMPTY = 0xFFFFFFFF
# Two sets are near if their symmetric difference has at most this share of their summed sizes.
MOST_APART = (1 - THRESHOLD) / (1 + THRESHOLD)
# Bits of the short parity sketch; the long one has two to four bits per shingle, up to LONGEST.
SKETCH = 256
LONGEST = 1 << 16
# Pairs of one bucket compared under one key, about.
CELL = 1 << 22
# Bands that a task sorts at once, and lines whose bands are one group, about.
PORTION = 1 << 20
GROUP_LINES = 1 << 15
# Bytes of the lines compared at once, about, and the code points from which on five do not fit one number.
PAIR_BYTES = 1 << 20
FAR = (1 << 12) - 1
# Lines of one bucket in a portion; where there are more, Spark joins them.
DENSE = 64
PRIME32 = np.uint32(0x01000193)


def _name(line: str) -> Column:
    """A 64-bit name of a line; among a billion different lines two share one with probability 0.03."""
    return F.xxhash64(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``: every line with something on it, trimmed, of the rows that have an id and a text."""
    single = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    # Trimming copies a line, and few lines need it.
    blank, raw = " \t\n\x0b\x0c\r", F.col("raw")
    wide = reduce(or_, [raw.startswith(c) | raw.endswith(c) for c in blank])
    return single.select("doc_id", "line_no", F.when(wide, F.btrim(raw, F.lit(blank))).otherwise(raw).alias("line")).filter(
        F.col("line") != "")


def code_points(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The code points of valid UTF-8 whose characters begin at ``heads``."""
    code = data[heads].astype(np.uint32)
    at = np.flatnonzero(code >= 0xC0)
    lead, first = code[at], heads[at]
    for least, keep, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        own = lead >= least
        if own.any():
            value = lead[own] & keep
            for k in range(1, size):
                value = (value << 6) | (data[np.minimum(first[own] + k, len(data) - 1)] & 0x3F)
            code[at[own]] = value
    return code


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, first and last byte border of every line with a word, its ends trimmed."""
    found = words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    text = found.text_of()
    number = np.searchsorted(breaks, found.starts) - np.searchsorted(breaks, offsets)[text]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text)) - 1
    return text[first], number[first], found.starts[first], found.ends[last[:len(first)]]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values``, each as one binary."""
    ends = np.concatenate(([0], np.cumsum(sizes * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


@lru_cache(maxsize=256)
def _drawn(bins: int, turn: int, size: int) -> np.ndarray:
    """``[bin, turn]``: the bins that an empty one tries in ``size`` turns from ``turn`` on."""
    tries = np.arange(bins)[:, None] * 1_000_003 + np.arange(turn, turn + size)
    return (_mix(tries.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)


def minhash(code: np.ndarray, begins: np.ndarray, chars: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``[line, band]`` hashes of lines of ``chars`` characters from ``code[begins]`` on.

    One permutation deals the shingles to ``bands * rows`` bins and each bin keeps its least hash; an empty bin borrows that
    of another bin, drawn by hash until a filled one is found, so that short lines still agree in proportion to their
    similarity.
    """
    bins = bands * rows
    mixed = _mix32(np.concatenate((code, np.zeros(SHINGLE, np.uint32))) + np.uint32(1))
    window = np.zeros(len(code), np.uint32)
    for k in range(SHINGLE):
        window = window * PRIME32 + mixed[k:k + len(code)]
    counts = np.maximum(chars - SHINGLE + 1, 1)
    # Lines come in order and never overlap, so the windows inside one are left by a mask.
    edge = np.zeros(len(code) + 1, np.int8)
    edge[begins] += 1
    edge[begins + counts] -= 1
    hashed = window[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    short = np.flatnonzero(chars < SHINGLE)  # one shingle: the line itself
    if len(short):
        value = np.zeros(len(short), np.uint32)
        for k in range(SHINGLE - 1):
            value = value * PRIME32 + np.where(k < chars[short], mixed[np.minimum(begins[short] + k, len(code))],
                                               np.uint32(k))
        hashed[(np.cumsum(counts) - counts)[short]] = value
    hashed = _mix32(hashed)
    at = hashed.astype(np.uint64)
    at *= np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(len(chars)) * bins, counts)
    source = np.full(len(chars) * bins, EMPTY, np.uint32)
    np.minimum.at(source, at, hashed)
    source = source.reshape(len(chars), bins)
    low = source.astype(np.uint64)
    (row, col), turn, size = np.nonzero(source == EMPTY), 1, 1
    while len(row):
        # More turns at once as fewer bins are left, those of lines with few shingles.
        tried = source[row[:, None], _drawn(bins, turn, size)[col]]
        won = (tried != EMPTY).argmax(axis=1)
        found = tried[np.arange(len(row)), won]
        good = found != EMPTY
        # The borrowed value is marked with its turn, as in any other line with the same shingles.
        low[row[good], col[good]] = found[good] + (turn + won[good]).astype(np.uint64) * np.uint64(1 << 33)
        row, col, turn, size = row[~good], col[~good], turn + size, min(2 * size, 64)
    joined = np.zeros((len(chars), bands), np.uint64)
    for k in range(rows):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + _mix(low[:, k::rows] + np.uint64(1))
    return _mix(joined + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, id, bands)`` of every line with something on it, of the rows that have an id.

    Of equal lines in one Arrow batch only the first has ``bands``, so a line that very many documents share is hashed once
    for many of them. ``id`` is Spark's ``xxhash64`` of the trimmed line, ``bands`` are 64-bit numbers as bytes.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            doc_ids, seen = batch.column(0).to_numpy(), set()
            for row, data, offsets in slices(batch.column(1)):
                text, number, starts, ends = split_lines(data, offsets)
                raw = data.tobytes()
                names = [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())]
                fresh = [k for k, name in enumerate(names) if not (name in seen or seen.add(name))]
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                begins, stops = np.searchsorted(heads, starts[fresh]), np.searchsorted(heads, ends[fresh])
                bands = minhash(code_points(data, heads), begins, stops - begins).view(np.int64)
                filled = np.zeros(len(names), np.int64)
                filled[fresh] = BANDS
                lists = _binaries(np.ascontiguousarray(bands).ravel(), filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[row + text]), pa.array(number.astype(np.int32)),
                     pa.array(np.array(names, np.uint64).view(np.int64)), lists], ["doc_id", "line_no", "id", "bands"])

    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(batches, "doc_id long, line_no int, id long, bands binary")


def pack_sketches(line: np.ndarray, hashed: np.ndarray, lines: int) -> list[pa.Array]:
    """``n``, ``short`` and ``sketch`` of each line from the hashes of its different shingles.

    A bit is the parity of the shingles hashed to it. Shingles that two lines share cancel out, so at least as many
    shingles belong to one of them alone as their sketches differ in bits. All sketches use the low bits of one hash, so a
    longer one is brought to a shorter one's size by adding its halves.
    """
    n = np.bincount(line, minlength=lines)
    bits = np.minimum(SKETCH << np.ceil(np.log2(np.maximum(2 * n / SKETCH, 1))).astype(np.int64), LONGEST)

    def packed(sizes: np.ndarray) -> pa.Array:
        place = (np.cumsum(sizes) - sizes)[line] + (hashed & (sizes[line] - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(place, minlength=int(sizes.sum())) & 1).astype(np.uint8)
        ends = np.concatenate(([0], np.cumsum(sizes // 64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))

    return [pa.array(n), packed(np.full(lines, SKETCH)), packed(bits)]


SKETCHED = "id long, n long, short array<long>, sketch array<long>"


def sketches(texts: DataFrame) -> DataFrame:
    """``(id, n, short, sketch)`` of ``(id, line)``: the number of different shingles and two parity sketches."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row, data, offsets in slices(batch.column(1)):
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                code = code_points(data, heads)
                begins = np.searchsorted(heads, offsets[:-1])
                chars = np.searchsorted(heads, offsets[1:]) - begins
                mixed = _mix(np.concatenate((code, np.zeros(SHINGLE, np.uint32))).astype(np.uint64) + np.uint64(1))
                window = np.zeros(len(code) + 1, np.uint64)
                for k in range(SHINGLE):
                    window[:-1] = window[:-1] * PRIME + mixed[k:k + len(code)]
                counts = np.maximum(chars - SHINGLE + 1, 1)
                first = np.cumsum(counts) - counts
                hashed = window[np.repeat(begins - first, counts) + np.arange(int(counts.sum()))]
                for k in np.flatnonzero(chars < SHINGLE):  # one shingle: the line itself
                    hashed[first[k]] = xxhash.xxh64_intdigest(data[offsets[k]:offsets[k + 1]].tobytes(), 42)
                # A slice has fewer than 2^20 lines, so line and hash are sorted as one number.
                both = (np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(44)) | (
                    _mix(hashed) >> np.uint64(20))
                both.sort()
                fresh = np.ones(len(both), bool)
                fresh[1:] = both[1:] != both[:-1]
                both = both[fresh]
                arrays = pack_sketches((both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1), len(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), *arrays],
                                                 ["id", "n", "short", "sketch"])

    return texts.select("id", "line").mapInArrow(batches, SKETCHED)


def _differing(a: str, b: str) -> Column:
    """In how many bits two sketches differ, once the longer one is brought to the size of the other."""
    def halved(x: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def fit(x: str, y: str) -> Column:
        return F.when(F.size(x) > F.size(y), halved(x)).otherwise(F.col(x))

    return F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0),
                       lambda total, x: total + x)


def _sizes_fit() -> Column:
    return F.least("a_n", "b_n") + 1 >= F.greatest("a_n", "b_n") * THRESHOLD


def may_be_near(also: Column | None = None) -> Column:
    """Of rows with both lines' sketches, all but those that these prove to be less alike than the threshold: first by
    their sizes, then by the short sketches, then by the long ones, for which ``also`` must hold."""
    short = sum((F.bit_count(F.get("a_short", k).bitwiseXOR(F.get("b_short", k))) for k in range(SKETCH // 64)), F.lit(0))
    most = (F.col("a_n") + F.col("b_n")) * MOST_APART + 1
    first = _sizes_fit() & (short <= most)
    return (first if also is None else first & also) & (_differing("a_sketch", "b_sketch") <= most)


def character_shingles(line: str) -> set[str]:
    """The different shingles of a line."""
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def packed_shingles(lines: pa.Array) -> list[np.ndarray | None]:
    """The different shingles of each line as sorted numbers, one to one; None if a character is too far up for that."""
    found: list[np.ndarray | None] = []
    for _, data, offsets in slices(lines):
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        code = code_points(data, heads)
        begins = np.searchsorted(heads, offsets)
        far = np.concatenate(([0], np.cumsum(code >= FAR)))[begins]
        ranks = np.concatenate((code.astype(np.uint64) + np.uint64(1), np.zeros(SHINGLE, np.uint64)))
        window = np.zeros(len(code), np.uint64)
        for k in range(SHINGLE):
            window = (window << np.uint64(12)) | ranks[k:k + len(code)]
        for a, b, beyond in zip(begins[:-1].tolist(), begins[1:].tolist(), (far[1:] > far[:-1]).tolist()):
            if beyond:
                found.append(None)
            elif b - a < SHINGLE:  # one shingle: the line itself
                found.append(np.array([sum(int(x) << 12 * k for k, x in enumerate(ranks[a:b]))], np.uint64))
            else:
                sorted_ = np.sort(window[a:b - SHINGLE + 1])
                found.append(sorted_[_runs(sorted_)])
    return found


def jaccard_pairs(pairs: DataFrame, threshold: float = THRESHOLD,
                  shingles_of: Callable[[str], set] = character_shingles) -> DataFrame:
    """Pairs ``(a, b)`` of ``(a, b, line_a, line_b)`` whose shingle sets reach the threshold, counted exactly."""
    def near(line_a: pa.Array, line_b: pa.Array) -> list[bool]:
        both = pa.concat_arrays([line_a, line_b]).dictionary_encode()
        packed = packed_shingles(both.dictionary) if shingles_of is character_shingles else [None] * len(both.dictionary)
        sets, places, keep = {}, both.indices.to_pylist(), []

        def shingles(place: int) -> set:
            if place not in sets:
                sets[place] = shingles_of(both.dictionary[place].as_py())
            return sets[place]

        for i, j in zip(places[:len(line_a)], places[len(line_a):]):
            x, y = packed[i], packed[j]
            if x is None or y is None:
                x, y = shingles(i), shingles(j)
                common = len(x & y)
            else:
                merged = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
            keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
        return keep

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            line_a, line_b = (batch.column(name).cast(pa.large_string()) for name in ("line_a", "line_b"))
            size = np.cumsum(pc.add(pc.binary_length(line_a), pc.binary_length(line_b)).to_numpy())
            # At least one pair, and as many as PAIR_BYTES hold.
            cuts = np.append(_runs(size // PAIR_BYTES), len(size))
            keep = [x for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist())
                    for x in near(line_a.slice(at, end - at), line_b.slice(at, end - at))] if len(size) else []
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return pairs.mapInArrow(batches, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingles_of: Callable[[str], set]) -> DataFrame:
    """Near pairs among candidates ``(a, b)``; ``texts`` has the line of each id. Only lines of candidates are sent about."""
    pairs = cut_lineage(pairs.distinct())
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    lines = cut_lineage(texts.join(asked, "id", "left_semi"))
    with_a = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    with_b = with_a.join(lines.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return cut_lineage(jaccard_pairs(with_b.select("a", "b", "line_a", "line_b"), shingles_of=shingles_of))


def _dealt(band: np.ndarray, ids: np.ndarray, groups: int) -> pa.RecordBatch:
    """``(part, bands, ids)`` of a portion: bands of one range are one part.

    A bucket of more than ``DENSE`` rows sends only its least and largest id there, and all its rows to a part of the
    portion's own, from ``groups`` on, so a part has at most ``DENSE`` rows of a bucket from each portion.
    """
    order = np.argsort(band)
    band, ids = band[order], ids[order]
    starts = _runs(band)
    counts = np.diff(np.append(starts, len(band)))
    large = counts > DENSE
    dense = np.repeat(large, counts)
    # The first two rows of such a bucket stand for its ends.
    least, most, two = np.minimum.reduceat(ids, starts)[large], np.maximum.reduceat(ids, starts)[large], starts[large]
    kept, ends = ~dense, ids.copy()
    kept[two] = kept[two + 1] = True
    ends[two], ends[two + 1] = least, most
    near, near_ids = band[kept], ends[kept]
    # Ranges of the upper half of a band; the extra rows come last, so their parts may be rows of their own.
    part = ((near >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    own = groups + int(ids.view(np.uint64).sum() % np.uint64(groups))
    part = np.concatenate((part, np.full(int(dense.sum()), own)))
    first = _runs(part)
    sizes = np.diff(np.append(first, len(part)))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first]), _binaries(np.concatenate((near, band[dense])), sizes),
         _binaries(np.concatenate((near_ids, ids[dense])), sizes)], ["part", "bands", "ids"])


def bucket_members(signed: DataFrame) -> DataFrame:
    """``(band, id, first)``, each once: the lines of every band that different lines have, and the least of their ids.

    ``signed`` is a written table of ``(id, bands)``, bands being 64-bit hashes, a list or their bytes. Nearly all bands
    have one line, so tasks sort theirs as arrays and send them about in runs. A group is a range of bands, and the number
    of groups grows with the lines.
    """
    groups = max(1, -(-signed.count() // GROUP_LINES))

    def portions(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            lists = batch.column(1)
            if pa.types.is_binary(lists.type):
                lengths = pc.divide(pc.binary_length(lists), 8)
                bands = np.frombuffer(b"".join(lists.drop_null().to_pylist()), np.uint64)
            else:
                lengths, bands = pc.list_value_length(lists), lists.flatten().to_numpy().view(np.uint64)
            ids = np.repeat(batch.column(0).to_numpy(), pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
            held.append((bands, ids))
            size += len(bands)
            if size >= PORTION:
                yield _dealt(*(np.concatenate(x) for x in zip(*held)), groups)
                held, size = [], 0
        if size:
            yield _dealt(*(np.concatenate(x) for x in zip(*held)), groups)

    def shared(table: pa.Table) -> pa.Table:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        band, ids = joined("bands", np.uint64), joined("ids", np.int64)
        order = np.argsort(band)
        band, ids = band[order], ids[order]
        starts = _runs(band)
        counts = np.diff(np.append(starts, len(band)))
        least, most = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        whole = table.column("part")[0].as_py() < groups
        kept = np.repeat(least < most, counts) if whole else np.ones(len(band), bool)
        band, ids, first = band[kept], ids[kept], np.repeat(least, counts)[kept]
        order = np.lexsort((ids, band))
        band, ids, first = band[order], ids[order], first[order]
        fresh = np.ones(len(band), bool)
        fresh[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1])
        band, ids, first = band[fresh].view(np.int64), ids[fresh], first[fresh]
        # A part of its own knows no other portion's ids.
        return pa.table({"band": band, "id": ids, "first": pa.array(first, mask=np.full(len(first), not whole))})

    dealt = signed.select("id", "bands").mapInArrow(portions, "part long, bands binary, ids binary")
    found = cut_lineage(dealt.groupBy("part").applyInArrow(shared, "band long, id long, first long"))
    members, dense = found.filter("first IS NOT NULL"), found.filter("first IS NULL")
    if dense.isEmpty():
        return members
    firsts = members.select("band", "first").distinct()
    return cut_lineage(members.union(dense.select("band", "id").join(firsts, "band").select("band", "id", "first"))
                       .distinct())


def line_components(signed: DataFrame, lines: DataFrame, shingles_of: Callable[[str], set] = character_shingles,
                    sketches_of: Callable[[DataFrame], DataFrame] = sketches) -> DataFrame:
    """``(id, root)`` of the lines in a component of two or more different lines.

    ``signed`` is a written table of ``(id, bands)``; ``lines`` is ``(line, id)``. Other texts than lines bring their own
    shingles, and sketches of these.

    In each bucket every line meets the bucket's first line. Lines that this joins need no further pair among
    themselves. Those left over in a bucket, and only those, then meet every line of the bucket that is not yet in their
    component, so a bucket of true copies costs one pair per line. Lines meet by their sketches, whatever the size of the
    bucket: only pairs that these prove to be apart are left out, and the others are compared shingle by shingle.
    """
    with scratch(signed.sparkSession) as own:
        found = _line_components(signed, lines, shingles_of, sketches_of)
        own.keep_all_of([found])
    return found


def _line_components(signed: DataFrame, lines: DataFrame, shingles_of: Callable[[str], set],
                     sketches_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    members = bucket_members(signed)
    # The numbers of a part are few beside its texts, so these need no sort.
    texts = cut_lineage(lines.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
                        .groupBy("id", "line").agg(F.count(F.lit(1)).alias("n")).select("id", "line"))
    known = cut_lineage(sketches_of(texts))

    def with_known(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.join(known.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns]), name)

    pairs = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    # Most pairs go by their sizes, before the sketches are joined.
    sized = with_known(with_known(pairs, "b", "n"), "a", "n").filter(_sizes_fit())
    star = with_known(with_known(sized, "a", "short", "sketch"), "b", "short", "sketch").filter(may_be_near())
    star = _verified(star.select("a", "b"), texts, shingles_of)
    roots = connected_components(star, "a", "b", smallest=True)

    def rooted(df: DataFrame, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(name), F.col("component").alias(f"{name}_root")), name,
                       "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))

    placed = rooted(rooted(members, "id"), "first").select("band", "id", "id_root", "first_root")
    left_over = cut_lineage(placed.filter("id_root <> first_root").select("band", F.col("id").alias("a"),
                                                                          F.col("id_root").alias("a_root")))
    if left_over.isEmpty():
        return roots.select(F.col("node").alias("id"), F.col("component").alias("root"))
    # Near is not transitive, so the first line of a bucket does not stand for the others here.
    sizes = left_over.groupBy("band").agg(F.count(F.lit(1)).alias("n_left")).join(
        members.groupBy("band").agg(F.count(F.lit(1)).alias("n_all")), "band")
    # A bucket of two has met already. A large one is cut both ways into cells, each a key of its own.
    cuts = cut_lineage(sizes.filter("n_all > 2").select("band", F.ceil(F.sqrt(
        F.col("n_left") * F.col("n_all") / CELL)).cast("int").alias("cut")))

    def listed(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """The lines of buckets with all their buckets and their sketches, dealt to cells."""
        at = F.sort_array(F.collect_list(F.struct("band", "cut", "is_left"))).alias("at")
        each = with_known(df.join(cuts, "band").groupBy(name, f"{name}_root").agg(at), name, "n", "short", "sketch")
        each = each.withColumn(f"{name}_bands", F.col("at.band")).withColumn("at", F.explode("at")).select(
            "at.*", *[c for c in each.columns if c != "at"], f"{name}_bands").withColumnRenamed("is_left", f"{name}_left")
        return each.withColumn(own, F.pmod(F.xxhash64(name), "cut").cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).drop("cut")

    left = listed(left_over.withColumn("is_left", F.lit(True)), "a", "row", "col")
    right = listed(placed.select("band", F.col("id").alias("b"), F.col("id_root").alias("b_root"),
                                 (F.col("id_root") != F.col("first_root")).alias("is_left")), "b", "col", "row")
    # A pair of several buckets meets in the first where ``a`` is left over; where both are, the smaller one is ``a``.
    once = (F.col("band") == F.array_min(F.array_intersect("a_bands", "b_bands"))) & (
        ~F.col("b_left") | (F.col("a") < F.col("b")))
    more = left.join(right, ["band", "row", "col"]).filter((F.col("a_root") != F.col("b_root")) & may_be_near(once)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = star.unionByName(_verified(more, texts, shingles_of))
    return connected_components(edges, "a", "b", smallest=True).select(F.col("node").alias("id"),
                                                                       F.col("component").alias("root"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, keep_doc, keep_line)``: every line that is a near or exact copy of another, without the kept one.

    Of each component the first line by ``(doc_id, line_no)`` is kept. Equal lines are one node from the start, so a line
    that very many documents share is never paired with itself. Null or empty texts have no lines, rows without a
    ``doc_id`` take no part, repeated rows of a document are further copies at the same place and change nothing, and an
    empty table has no duplicates.
    """
    with scratch(docs.sparkSession) as own:
        gone = cut_lineage(_copies(cut_lineage(signed_lines(docs)), docs))
        own.keep_all_of([gone])
    return gone


def _copies(signed: DataFrame, docs: DataFrame) -> DataFrame:
    found = line_components(signed, lines_of(docs).select("line", _name("line").alias("id")))
    copied = signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    marked = cut_lineage(copied.join(found, "id", "full").select("id", F.coalesce("root", "id").alias("root")))
    placed = cut_lineage(signed.join(marked, "id").select("doc_id", "line_no", "root"))
    kept = placed.groupBy("root").agg(F.min("doc_id").alias("keep_doc"))
    of_doc = (placed.join(kept, "root").filter("doc_id = keep_doc").groupBy("root", "keep_doc")
              .agg(F.min("line_no").alias("keep_line")))
    return (placed.join(of_doc, "root").filter("doc_id <> keep_doc OR line_no <> keep_line")
            .select("doc_id", "line_no", "keep_doc", "keep_line"))


def drop_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` without the lines ``(doc_id, line_no)``; the others keep their order. No document goes: one whose lines
    are all copies stays with an empty text."""
    # Names that no column of the caller has.
    gone, key = (f"{name}_{len(''.join(docs.columns))}" for name in ("_gone", "_key"))
    per_doc = lines.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(per_doc, F.col("doc_id") == F.col(key), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every near-duplicate line gone but the first of its component."""
    return drop_lines(docs, duplicate_lines(docs))


def report(docs: DataFrame) -> DataFrame:
    """The result of ``op8_line_dedup``: every document with its number of lines and the lines removed."""
    with scratch(docs.sparkSession) as own:
        signed = cut_lineage(signed_lines(docs))
        per_doc = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
        gone = _copies(signed, docs).groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("line_no", "keep_doc", "keep_line"))).alias("copies"))
        counted = cut_lineage(per_doc.join(gone, "doc_id", "left"))
        own.keep_all_of([counted])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("copies"), F.lit(0)).cast("long").alias("n_removed"), "copies")
