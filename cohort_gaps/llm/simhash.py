"""Near duplicates by SimHash fingerprints, found through generalised pigeonhole partitions.

The 64 bits are dealt to partitions, correlated bits together. If the thresholds of the partitions add up to
``distance - partitions + 1``, two fingerprints within ``distance`` differ by at most its threshold in some partition. Each
fingerprint chooses its own thresholds, by dynamic programming over estimated candidate counts; -1 leaves a partition out.

``keep_first`` goes by the shared five-word shingles themselves: texts with four fifths of them in common are 10 bits apart in
the mean, where 64 bits tell near from far no longer. There MinHash bands give the candidates. A stage of the pipeline takes
both kinds of links.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .line_dedup import SKETCHED, line_components, pack_sketches
from .text import _mix

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
# A partition value that more distinct fingerprints share is refined by the bits outside the partition.
HOT = 256
# Cost of one probe, in candidates.
PROBE_COST = 2.0
# Widest run of bits counted value by value.
COUNTED_BITS = 16
# Near copies of the pipeline: Jaccard similarity 0.8 of the sets of five-word shingles. A pair at the threshold shares a
# band with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
NEAR_WORDS = 5
BANDS, ROWS = 20, 5
FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(size, len(words))
    votes = np.zeros(BITS, np.int64)
    first, last = starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])],
                          np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(votes * 2 > len(first), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` per row."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 correlation of fingerprint bits; only sums over all rows leave the tasks."""
    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for batch in rows:
            bits = _bits(np.ascontiguousarray(batch.column(0).to_numpy())).astype(np.float64)
            total[:BITS] += bits.T @ bits
            total[BITS] += bits.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    summed = fps.select("fp").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    table = summed.toPandas()  # 65 x 64 rows, whatever the input
    both = np.zeros((BITS + 1) * BITS)
    both[table["k"].to_numpy()] = table["v"].to_numpy()
    both = both.reshape(BITS + 1, BITS)
    n = max(fps.count(), 1)
    mean = both[BITS] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs(both[:BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread)


def deal_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of nearly equal width: each starts with the most correlated free pair and takes the free bit that is
    most correlated with it, smallest number first on ties."""
    free, out = list(range(BITS)), []
    for k in range(partitions):
        width = (len(free) + partitions - k - 1) // (partitions - k)
        if len(free) <= width:
            out.append(sorted(free))
            break
        pair = max(combinations(free, 2), key=lambda p: (correlation[p[0], p[1]], -p[0], -p[1]))
        group = list(pair)[:width]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (correlation[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def flips(bits: list[int], most: int) -> list[int]:
    """Signed masks of at most ``most`` of the bits."""
    return [_signed(_mask(list(c))) for k in range(most + 1) for c in combinations(bits, k)]


def _compact(values: np.ndarray, bits: list[int]) -> np.ndarray:
    return _bits(values)[:, bits].astype(np.int64) @ (1 << np.arange(len(bits), dtype=np.int64))


def near_counts(fps: DataFrame, runs: list[list[int]], distance: int) -> list[np.ndarray]:
    """Per run of bits an array ``[d, value]``: how many fingerprints are exactly ``d`` away from the value there.

    Runs have at most COUNTED_BITS bits, which bounds the table: at most 4 x 65,536 counts.
    """
    def counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(r), np.int64) for r in runs]
        for batch in rows:
            values = np.ascontiguousarray(batch.column(0).to_numpy())
            for total, run in zip(totals, runs):
                total += np.bincount(_compact(values, run), minlength=len(total))
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])],
                                             ["run", "value", "n"])

    table = (fps.select("fp").mapInArrow(counts, "run long, value long, n long")
             .groupBy("run", "value").agg(F.sum("n").alias("n")).toPandas())
    out = []
    for k, run in enumerate(runs):
        exact = np.zeros(1 << len(run))
        own = table[table["run"] == k]
        exact[own["value"].to_numpy(dtype=np.int64)] = own["n"].to_numpy()
        at = np.arange(len(exact))
        out.append(np.stack([sum((exact[at ^ _mask(list(c))] for c in combinations(range(len(run)), d)),
                                 np.zeros(len(exact))) for d in range(distance + 1)]))
    return out


def thresholds(costs: np.ndarray, total: int) -> np.ndarray:
    """Per row the thresholds of least summed cost that add up to ``total``.

    ``costs[row, partition, t + 1]`` is the cost of threshold ``t`` from -1 on; the smallest threshold wins ties.
    """
    rows, parts, kinds = costs.shape
    low = -parts
    sums = total - low + 1 + parts  # before the last partitions a sum may lie above the total
    best = np.full((rows, sums), np.inf)
    best[:, -low] = 0.0
    chosen = []
    for k in range(parts):
        following, pick = np.full((rows, sums), np.inf), np.zeros((rows, sums), np.int8)
        for t in range(-1, kinds - 1):
            src = slice(max(0, -t), sums - max(0, t))
            dst = slice(max(0, t), sums - max(0, -t))
            value = best[:, src] + costs[:, k, t + 1][:, None]
            better = value < following[:, dst]
            following[:, dst] = np.where(better, value, following[:, dst])
            pick[:, dst] = np.where(better, t, pick[:, dst])
        best = following
        chosen.append(pick)
    out, at = np.zeros((rows, parts), np.int64), np.full(rows, total - low)
    for k in reversed(range(parts)):
        out[:, k] = chosen[k][np.arange(rows), at]
        at = at - out[:, k]
    return out


def links(fps: DataFrame, distance: int = 2, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct fingerprints at most ``distance`` bits apart; none is missed.

    ``fps`` is a written table of distinct ``fp``. ``partitions`` follows from the number of fingerprints, so that a value
    of a partition stays selective. A value shared by more than ``hot`` fingerprints meets through the bits outside the
    partition instead: two fingerprints at most two bits apart there have a common neighbour at one bit, so both sides
    list theirs and only near ones meet.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    n = fps.count()
    if partitions is None:
        partitions = max(2, min(3, BITS // max(1, n.bit_length())))
    groups = deal_bits(correlations(fps), partitions)
    split = [[g[at:at + math.ceil(len(g) / math.ceil(len(g) / COUNTED_BITS))]
              for at in range(0, len(g), math.ceil(len(g) / math.ceil(len(g) / COUNTED_BITS)))] for g in groups]
    runs = [r for parts in split for r in parts]
    near = near_counts(fps, runs, distance)
    masks = [_mask(g) for g in groups]
    probes_of = [[np.array(flips(g, t), np.int64) for t in range(distance + 1)] for g in groups]
    shared = fps.sparkSession.sparkContext.broadcast([x.astype(np.float32) for x in near])

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in rows:
            fp = np.ascontiguousarray(batch.column(0).to_numpy())
            costs, at = np.zeros((len(fp), len(groups), distance + 2)), 0
            for k, parts in enumerate(split):
                # Estimate: runs of a partition as if independent.
                within = np.zeros((len(fp), distance + 1))
                within[:, 0] = n
                for run in parts:
                    own = counts[at][:, _compact(fp, run)].T / max(n, 1)
                    within = np.stack([sum(within[:, d - e] * own[:, e] for e in range(d + 1))
                                       for d in range(distance + 1)], 1)
                    at += 1
                tried = np.array([len(p) for p in probes_of[k]])
                costs[:, k, 1:] = np.cumsum(within, 1) + PROBE_COST * tried
            chosen = thresholds(costs, distance - len(groups) + 1)
            for k, mask in enumerate(masks):
                for t in range(distance + 1):
                    own = fp[chosen[:, k] == t]
                    keys = ((own & np.int64(_signed(mask)))[:, None] ^ probes_of[k][t][None, :]).ravel()
                    again = np.repeat(own, len(probes_of[k][t]))
                    for a in range(0, len(keys), 1 << 16):
                        part = slice(a, a + (1 << 16))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys[part]), k, np.int32)), pa.array(keys[part]),
                             pa.array(again[part])], ["part", "key", "fp"])

    signed = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    index = fps.select(F.posexplode(signed).alias("part", "mask"), F.col("fp").alias("other")).select(
        "part", F.col("mask").bitwiseAND(F.col("other")).alias("key"), "other")
    probes = fps.select("fp").mapInArrow(probe, "part int, key long, fp long")
    crowded = cut_lineage(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
                          .select("part", "key"))
    near_enough = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance) & (F.col("fp") != F.col("other"))
    at = ["part", "key"]
    plain = probes.join(crowded, at, "left_anti").join(index, at).filter(near_enough)

    outside = F.array(*[F.array(*[F.lit(v).cast("long") for v in flips([b for b in range(BITS) if b not in g], 1)])
                        for g in groups])
    step = F.explode(F.element_at(outside, F.col("part") + 1)).alias("step")

    def spread(df: DataFrame, name: str) -> DataFrame:
        rest = F.col(name).bitwiseAND(F.bitwise_not(F.element_at(signed, F.col("part") + 1)))
        return (df.join(crowded, at, "left_semi").select("part", "key", name, rest.alias("rest"), step)
                .select("part", "key", name, F.col("rest").bitwiseXOR(F.col("step")).alias("meet")))

    met = spread(probes, "fp").join(spread(index, "other"), [*at, "meet"]).filter(near_enough)
    both = plain.select("fp", "other").unionByName(met.select("fp", "other"))
    return both.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: the smallest ``doc_id`` reachable through near fingerprints.

    Documents with equal fingerprints are one node, so copies cost one row each and are never paired. A null text counts
    as empty; texts without words share the fingerprint zero and link like any other. A row without a ``doc_id`` takes
    part but gives no component its name; repeated rows give repeated results; an empty table gives an empty one.
    """
    known = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(links(nodes.select("fp"), distance), "a", "b", smallest=True).withColumnRenamed("node", "fp")
    rooted = cut_lineage(nodes.join(parts, "fp", "left").select("fp", "first_id",
                                                                F.coalesce("component", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return known.join(named, "fp").select("doc_id", "fp", "component_id")


def word_shingles(text: str) -> set[bytes]:
    """The different five-word shingles of a text; all its words, if it has fewer; none without words."""
    words = text.encode().lower().split()
    span = min(NEAR_WORDS, max(1, len(words)))
    return {b" ".join(words[k:k + span]) for k in range(len(words) - span + 1)}


def _hashes(shingles: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def word_bands(text: str) -> np.ndarray:
    """BANDS signed hashes of a text, each of the least values of ROWS random orders of its shingles; none without words."""
    hashed = _hashes(word_shingles(text))
    if len(hashed) == 0:
        return np.zeros(0, np.int64)
    low = np.min([(hashed[at:at + 1024, None] * FACTORS).min(0) for at in range(0, len(hashed), 1024)], axis=0)
    joined = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + _mix(low[k::ROWS] + np.uint64(1))
    return _mix(joined + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def _words_of(text: str | None) -> tuple[str, int]:
    """The words of a text with single spaces between, in small letters, and their 64-bit name."""
    joined = b" ".join((text or "").encode().lower().split())
    return joined.decode(), _signed(xxhash.xxh64_intdigest(joined, SEED))


def word_sketches(texts: DataFrame) -> DataFrame:
    """Numbers and sketches of ``(id, line)``, as ``line_dedup.sketches`` has them for lines."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                hashed = [_hashes(word_shingles(text.as_py())) for text in part.column(1)]
                line = np.repeat(np.arange(len(part)), [len(x) for x in hashed])
                arrays = pack_sketches(line, np.concatenate(hashed), len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["id", "n", "short", "sketch"])

    return texts.select("id", "line").mapInArrow(batches, SKETCHED)


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_id)`` per row with an id: the smallest ``doc_id`` reachable through near copies.

    Candidates share a MinHash band; the similarity is counted exactly. Texts with the same words are one node, and texts
    without words are copies of each other. Texts are named by 64-bit hashes, as lines are.
    """
    def signed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            named = [_words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in named], pa.int64()),
                 pa.array([word_bands(w) for w, _ in named], pa.list_(pa.int64()))], ["doc_id", "id", "bands"])

    def worded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            named = [_words_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in named], pa.string()),
                                              pa.array([n for _, n in named], pa.int64())], ["line", "id"])

    own = docs.filter(F.col("doc_id").isNotNull())
    known = cut_lineage(own.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                        .mapInArrow(signed, "doc_id long, id long, bands array<long>"))
    nodes = cut_lineage(known.groupBy("id").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands")))
    found = line_components(nodes.select("id", "bands"), own.select("text").mapInArrow(worded, "line string, id long"),
                            word_shingles, word_sketches)
    rooted = cut_lineage(nodes.select("id", "least_id").join(found, "id", "left").select(
        "id", "least_id", F.coalesce("root", "id").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("least_id").alias("first_id"))
    return known.select("doc_id", "id").join(rooted.join(firsts, "root").select("id", "first_id"), "id").select(
        "doc_id", "first_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_id)`` per row with an id: the smallest ``doc_id`` reachable through near fingerprints and near
    copies, in any order."""
    own = docs.filter(F.col("doc_id").isNotNull())
    links = near_duplicates(own).select("doc_id", F.col("component_id").alias("first_id")).unionByName(near_copies(own))
    links = cut_lineage(links.distinct())
    parts = connected_components(links, "doc_id", "first_id", smallest=True).select(
        F.col("node").alias("doc_id"), "component")
    return links.select("doc_id").distinct().join(parts, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("first_id"))


def keep_first(docs: DataFrame, fingerprints_too: bool = False) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest ``doc_id``.

    With ``fingerprints_too`` documents with near fingerprints belong together as well. A repeated row of that document goes
    too. Rows without a ``doc_id`` are not judged and stay.
    """
    firsts = (near_groups(docs) if fingerprints_too else near_copies(docs)).filter("doc_id = first_id").select(
        "doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(
        docs.filter(F.col("doc_id").isNull()))


def report(docs: DataFrame) -> DataFrame:
    """The result of ``op5_simhash``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")
