"""Whitening of embeddings by spectrum slicing: inertia counts isolate each leading eigenvalue, Rayleigh quotients find it.

Entries become whole numbers, so sums are exact. The vectors' covariance is summed by tasks that hold one square matrix
each; only that matrix, whose size is the vectors' length and not their number, reaches the driver. There the pivots of
an LDL' factorisation of the shifted matrix tell how many eigenvalues lie above the shift (Sylvester). Bisection by these
counts isolates the k-th largest, Rayleigh quotient iteration converges to it cubically, and two more counts certify that
what it found is number k.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch

SCALE = 256.0
COMPONENTS = 4
# Partial sums are added in this many heaps first.
HEAPS = 64
LONG_MAX = (1 << 63) - 1


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is there and has finite entries only: ``x`` is ``floor(256 * c) + 0``.

    A vector with an entry that has no place among longs that way goes too. An empty vector stays, with an empty ``x``.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < float(1 << 63)), F.lit(False)))
    return rows.filter(good).select("vec_id", F.transform("embedding", lambda c: F.floor(
        c.cast("double") * SCALE).cast("long")).alias("x"))


def _by_length(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and ``[row, entry]`` of the vectors of a batch, for each length above zero."""
    column = batch.column(name)
    lengths = np.diff(column.offsets.to_numpy())
    flat, begins = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, flat[begins[at][:, None] + np.arange(size)]


def _sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and entry the number of vectors and their sum, in an upper and a lower half that cannot overflow."""
    found: dict[int, list] = {}
    for batch in rows:
        for size, _, x in _by_length(batch):
            n, high, low = found.setdefault(size, [0, np.zeros(size, np.int64), np.zeros(size, np.int64)])
            found[size] = [n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)]
    for size, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
             pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["dim", "entry", "n", "high", "low"])


@dataclass
class Sums:
    """The number of different vectors of one length and the exact sums of their entries."""

    n: int
    total: list[int]

    @property
    def mean(self) -> np.ndarray:
        # A quotient of whole numbers is rounded once.
        return np.array([t / self.n for t in self.total])


def sums_of(fit: DataFrame) -> dict[int, Sums]:
    """The sums of a table ``(x)`` by vector length."""
    parts = fit.mapInArrow(_sums, "dim int, entry int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out: dict[int, Sums] = {}
    for row in parts.groupBy("dim", "entry").agg(F.sum("n").alias("n"), *wide).orderBy("dim", "entry").collect():
        out.setdefault(row.dim, Sums(row.n, [])).total.append((int(row.high) << 32) + int(row.low))
    return out


def _moments(means: dict[int, np.ndarray]):
    """A task's work: per length the sum of the products of centred entries, a row of the matrix per row."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in rows:
            for size, _, x in _by_length(batch):
                centred = x.astype(np.float64) - means[size]
                found[size] = found.get(size, 0.0) + centred.T @ centred
        heap = np.random.default_rng().integers(HEAPS)
        for size, matrix in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.array(np.full(size, heap, np.int32)), pa.array(list(matrix))], ["dim", "entry", "heap", "products"])

    return batches


def _added(table: pa.Table) -> pa.Table:
    first = table.slice(0, 1)
    total = np.sum(np.stack([np.asarray(x) for x in table["products"].to_numpy()]), axis=0)
    return first.set_column(first.schema.get_field_index("products"), "products", pa.array([total]))


def covariances(fit: DataFrame, sums: dict[int, Sums]) -> dict[int, np.ndarray]:
    """The covariance, with divisor n, of the vectors of each length."""
    kind = "dim int, entry int, heap int, products array<double>"
    parts = fit.mapInArrow(_moments({size: own.mean for size, own in sums.items()}), kind)
    added = parts.groupBy("dim", "entry", "heap").applyInArrow(_added, kind).groupBy("dim", "entry").applyInArrow(
        _added, kind)
    out = {size: np.zeros((size, size)) for size in sums}
    for row in added.select("dim", "entry", "products").collect():
        out[row.dim][row.entry] = np.array(row.products) / sums[row.dim].n
    return {size: (v + v.T) / 2 for size, v in out.items()}


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``.

    The factorisation ``L D L'`` of the shifted matrix, with pivots of one or two rows from the whole of what is left,
    has as many positive pivots. A pivot of two rows has one of either sign. Eigenvalues equal to the shift do not count.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive, growth = 0, (1 + 17 ** 0.5) / 8
    while len(a):
        size = np.abs(a)
        one = int(np.argmax(size.diagonal()))
        row, col = divmod(int(np.argmax(size)), len(a))
        if size[row, col] == 0:
            break
        if size[one, one] >= growth * size[row, col]:
            pivot = a[one, one]
            positive += pivot > 0
            rest = np.delete(np.arange(len(a)), one)
            line = a[rest, one]
            a = a[np.ix_(rest, rest)] - np.outer(line, line / pivot)
        else:
            two = [row, col]
            positive += 1
            rest = np.delete(np.arange(len(a)), two)
            lines = a[np.ix_(rest, two)]
            a = a[np.ix_(rest, rest)] - lines @ np.linalg.solve(a[np.ix_(two, two)], lines.T)
    return int(positive)


def rayleigh(matrix: np.ndarray, start: float, known: np.ndarray) -> tuple[float, np.ndarray]:
    """An eigenvalue next to ``start`` and its unit vector, at right angles to the rows of ``known``."""
    def solved(shift: float, vector: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 4.0, 64.0):
            try:
                out = np.linalg.solve(matrix - (shift + nudge * tiny) * np.eye(len(matrix)), vector)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all() and np.abs(out).max() > 0:
                break
        else:
            out = vector
        out = out / np.abs(out).max()
        for _ in range(2):
            out = out - known.T @ (known @ out)
        return out / np.linalg.norm(out)

    tiny = np.finfo(float).eps * max(np.abs(matrix).max(), np.finfo(float).tiny)
    vector = np.random.default_rng(len(matrix)).standard_normal(len(matrix))
    for _ in range(3):
        vector = solved(start, vector)
    value = float(vector @ matrix @ vector)
    error = np.linalg.norm(matrix @ vector - value * vector)
    for _ in range(30):
        closer = solved(value, vector)
        new_value = float(closer @ matrix @ closer)
        new_error = np.linalg.norm(matrix @ closer - new_value * closer)
        if new_error >= error:
            break
        vector, value, error = closer, new_value, new_error
    return value, vector


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues in falling order, up to ``most``, and their unit vectors as rows; those that are zero to
    double precision are left out. Equal eigenvalues get vectors at right angles."""
    size = len(matrix)
    bound = float(np.abs(matrix).sum(1).max()) if size else 0.0
    values, vectors = [], np.zeros((0, size))
    if bound == 0 or not np.isfinite(bound):
        return np.array(values), vectors
    counts = {-bound: size, 2 * bound: 0}
    margin = 8 * size * np.finfo(float).eps * bound

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    while len(values) < min(most, size):
        k = len(values) + 1
        low = max(s for s, n in counts.items() if n >= k)
        high = min(s for s, n in counts.items() if n < k and s > low)
        # The slice (low, high] holds number k; cut it until it holds no other, then until the iteration ends inside.
        while True:
            alone = above(low) == k and above(high) == k - 1
            if alone or high - low <= 2 * margin:
                value, vector = rayleigh(matrix, (low + high) / 2, vectors)
                if above(value - margin) >= k > above(value + margin):
                    break
                if high - low <= 2 * margin:
                    raise ArithmeticError(f"no eigenvector found for eigenvalue {k} near {value}")
            middle = (low + high) / 2
            if above(middle) >= k:
                low = middle
            else:
                high = middle
        if value <= margin:
            break
        values.append(value)
        vectors = np.vstack((vectors, vector))
    return np.array(values), vectors


def _projected(means: dict[int, np.ndarray], axes: dict[int, np.ndarray]):
    """``(dim, w)``: vectors on the whitened components of their length."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for size, at, x in _by_length(batch):
                w = (x.astype(np.float64) - means[size]) @ axes[size].T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(
                    list(w), pa.list_(pa.float64()))], ["dim", "w"])

    return batches


def identity_errors(fit: DataFrame, means: dict[int, np.ndarray], axes: dict[int, np.ndarray]) -> dict[int, float]:
    """Per length the largest absolute entry of the whitened vectors' covariance less the identity."""
    projected = fit.mapInArrow(_projected(means, axes), "dim int, w array<double>")
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i + 1)]
    found = projected.groupBy("dim").agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}")
                                           for i, j in pairs]).collect()
    return {row.dim: max((abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None), default=0.0)
            for row in found}


def _whitened(sums: dict[int, Sums], models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]):
    names = ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviations(x: np.ndarray, own: Sums) -> pa.Array:
        most = own.n * max(int(x.max()), -int(x.min()), 0) + max(abs(t) for t in own.total)
        if len(own.total) * most * most <= LONG_MAX:
            return pa.array(((own.n * x - np.array(own.total, np.int64)) ** 2).sum(1))
        exact = ((x.astype(object) * own.n - np.array(own.total, dtype=object)) ** 2).sum(1)
        return pa.array([int(v) if v <= LONG_MAX else None for v in exact], pa.int64())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for size, at, x in _by_length(batch):
                mean, axes, explained, error = models[size]
                count = len(axes)
                if count == 0:
                    continue
                w = (x.astype(np.float64) - mean) @ axes.T
                again = pa.array(np.repeat(np.arange(len(at)), count))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)).take(again),
                     pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(again), sums[size].n)), deviations(x, sums[size]).take(again),
                     pa.array(w.ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(again), error))],
                    ["vec_id", *names[1:]])

    return batches


def whiten(rows: DataFrame) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every row of ``rows`` with a vector of
    finite entries and each of its up to four components.

    The fit list holds each different vector once, so copies, however many, do not weigh. Vectors of different lengths are
    fitted apart, each length with its own ``n``. Components without variance (one vector alone, fewer dimensions than
    four, vectors on a line) are none, and their rows are missing. ``deviation`` is null where it is beyond a long. Rows
    without a ``vec_id`` and repeated ids are rows like others; an empty table gives no rows; other columns change nothing.
    """
    clean = whole_vectors(rows)
    with scratch(rows.sparkSession):
        fit = cut_lineage(clean.select("x").filter(F.size("x") > 0).distinct())
        sums = sums_of(fit)
        means = {size: own.mean for size, own in sums.items()}
        axes, explained = {}, {}
        for size, v in covariances(fit, sums).items():
            values, vectors = leading(v)
            axes[size] = vectors / np.sqrt(values)[:, None] if len(values) else vectors
            explained[size] = values / np.trace(v) if len(values) else values
        errors = identity_errors(fit, means, axes)
    models = {size: (means[size], axes[size], explained[size], errors[size]) for size in sums}
    kind = dict(clean.dtypes)["vec_id"]
    return clean.mapInArrow(_whitened(sums, models), f"vec_id {kind}, component int, n long, deviation long, "
                                                     "whitened double, explained double, identity_error double")


def report(embeddings: DataFrame) -> DataFrame:
    """The result of ``op13_whitening``."""
    return whiten(embeddings)
