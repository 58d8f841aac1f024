"""Embedding whitening by incremental eigendecomposition.

1. Every partition keeps the eigenvalues and eigenvectors of the scatter of the vectors
   it has read around their mean. A vector changes that scatter by a multiple of one
   outer product, and the new spectrum comes from the secular equation: components the
   vector does not touch, and equal eigenvalues, are deflated; the other eigenvalues
   are roots between the old ones, and the eigenvectors follow from them.
2. Two partitions' spectra are combined by the same updates: one for each eigenpair of
   the smaller, and one for the distance of the means. That is done in rounds of ``FAN``.
3. A pass over all rows projects them on the combined basis and gathers the projected
   covariance; its eigenvectors refine the basis to double precision (Rayleigh-Ritz).
4. A pass measures the covariance of the whitened rows against the identity.

An update costs some d**3 multiplications for d dimensions, one update for each distinct
vector of a batch. A task holds one batch and d x d matrices; the driver gets one spectrum
and two d x d matrices, however many rows and partitions there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

EPS = float(np.finfo(np.float64).eps)
FAN = 16  # spectra or matrices combined by one task
NO_VARIANCE = 1e-12  # eigenvalues up to this share of the trace count as zero
_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty and holds finite numbers only."""
    v = F.transform(vector, lambda c: c.cast("double"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def secular(d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weight / (d - x)) = 0 for ascending distinct ``d`` and positive ``weight``.

    Returns the n roots, one above each ``d``, and the matrix of d[j] - root[i], which is
    exact in relative terms: every root is found as a distance to its nearer pole. Each step
    interpolates the sum by the two poles around the root; a step that leaves the bracket
    is replaced by halving it.
    """
    n = len(d)
    top = d[-1] + weight.sum()
    width = np.append(d[1:], top) - d
    ahead = np.arange(n)[:, None] > np.arange(n)[None, :]  # pole j lies above root i
    mid = 1.0 + (weight[:, None] / ((d[:, None] - d[None, :]) - width / 2)).sum(axis=0)
    near = np.arange(n) + ((mid < 0) & (np.arange(n) < n - 1))
    gap = d[:, None] - d[near][None, :]
    own = np.where(near > np.arange(n), -width, 0.0)
    low = np.where(mid < 0, own + width / 2, own)
    high = np.where(mid < 0, own + width, own + width / 2)
    x = (low + high) / 2
    for _ in range(80):
        t = gap - x
        r = weight[:, None] / t
        f = 1.0 + r.sum(axis=0)
        done = np.abs(f) <= 4 * EPS * (1.0 + np.abs(r).sum(axis=0))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slope = r / t
        above = np.where(ahead, slope, 0.0).sum(axis=0)
        below = slope.sum(axis=0) - above
        left, right = own - x, own + width - x
        a = (left + right) * f - left * right * (below + above)
        b = left * right * f
        c = f - left * below - right * above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return d[near] + x, gap - x


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending) of V diag(values) V' + weight * u u'."""
    z = vectors.T @ u
    size = float(np.sqrt(z @ z))
    scale = max(float(values[-1]), weight * size * size)
    if not scale > 0:
        return values, vectors
    tiny = 8 * EPS * scale
    # equal eigenvalues: turn their eigenvectors so that only the last of them meets u
    same = np.diff(values) <= tiny
    if same.any():
        vectors = vectors.copy()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = z[a:b + 1]
            norm = np.sqrt(run @ run)
            mirror = run.copy()
            mirror[-1] += norm if run[-1] >= 0 else -norm
            length = mirror @ mirror
            if length > 0:
                vectors[:, a:b + 1] -= np.outer(vectors[:, a:b + 1] @ mirror, mirror * (2 / length))
                last = -norm if run[-1] >= 0 else norm
                z[a:b + 1] = 0.0
                z[b] = last
    live = np.flatnonzero(weight * np.abs(z) * size > tiny)
    if not len(live):
        return values, vectors
    d, zl = values[live], z[live]
    roots, gaps = secular(d, weight * zl * zl)
    # the weights for which these roots are exact: eigenvectors from them are orthogonal
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(gaps / apart.T, axis=1)))
    turn = np.copysign(exact, zl)[:, None] / gaps
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = roots
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """``n`` vectors by their mean and the eigenvalues and eigenvectors of their scatter around it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """One vector, ``times`` over."""
        apart = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + apart * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        apart, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / n)
        self.mean, self.n = self.mean + apart * (other.n / n), n


def _matrix(col: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _doubles(col: pa.ChunkedArray, i: int) -> np.ndarray:
    return np.frombuffer(col[i].as_py(), np.float64).copy()


def _combined(parts: DataFrame, fold: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Rows with a ``part`` number folded ``FAN`` at a time, round by round, until one is left."""
    parts = stored(parts, "parts")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(lambda t: fold(t.sort_by("part")), parts.schema)
        if left <= 1:
            return parts


_SPECTRUM = "part long, n long, sums array<string>, low array<long>, high array<long>, mean binary, vals binary, vectors binary"


def _spectrum_row(part: int, s: Spectrum, sums: list[int], low: list[int], high: list[int]) -> pa.Table:
    return pa.table({
        "part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()), "sums": pa.array([[str(x) for x in sums]], pa.list_(pa.string())),
        "low": pa.array([low], pa.list_(pa.int64())), "high": pa.array([high], pa.list_(pa.int64())),
        "mean": pa.array([s.mean.tobytes()], pa.binary()), "vals": pa.array([s.values.tobytes()], pa.binary()),
        "vectors": pa.array([s.vectors.tobytes()], pa.binary())})


def fitted_spectrum(rows: DataFrame, d: int) -> tuple[Spectrum, list[int], list[int], list[int]]:
    """Spectrum of the integer vectors in column ``x``, with their exact sums, minima and maxima per dimension."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums, low, high = Spectrum.empty(d), [0] * d, None, None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if not len(x):
                continue
            # the sums in two halves of 32 bits, so that no batch overflows
            upper, lower = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [t + (int(a) << 32) + int(b) for t, a, b in zip(sums, upper, lower, strict=True)]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            distinct, times = np.unique(x, axis=0, return_counts=True)
            for v, k in zip(distinct.astype(np.float64), times.tolist(), strict=True):
                s.add(v, k)
        if s.n:
            yield from _spectrum_row(TaskContext.get().partitionId(), s, sums, low.tolist(), high.tolist()).to_batches()

    def fold(t: pa.Table) -> pa.Table:
        total, sums = Spectrum.empty(d), [0] * d
        for i in range(len(t)):
            total.merge(Spectrum(t["n"][i].as_py(), _doubles(t["mean"], i), _doubles(t["vals"], i), _doubles(t["vectors"], i).reshape(d, d)))
            sums = [a + int(b) for a, b in zip(sums, t["sums"][i].as_py(), strict=True)]
        low, high = (f(np.array(t[c].to_pylist(), np.int64), axis=0).tolist() for c, f in (("low", np.min), ("high", np.max)))
        return _spectrum_row(t["part"][0].as_py(), total, sums, low, high)

    r = _combined(rows.select("x").mapInArrow(read, _SPECTRUM), fold).first()
    s = Spectrum(r.n, np.frombuffer(r["mean"]), np.frombuffer(r.vals), np.frombuffer(r.vectors).reshape(d, d))
    return s, [int(x) for x in r.sums], r.low, r.high


def _scatter(rows: DataFrame, project: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[int, np.ndarray]:
    """Number and covariance of the projected rows; every batch is centred before it is multiplied."""
    schema = "part long, n long, mean binary, scatter binary"

    def one(part: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()),
                         "mean": pa.array([mean.tobytes()], pa.binary()), "scatter": pa.array([scatter.tobytes()], pa.binary())})

    def joined(n: int, mean: np.ndarray, scatter: np.ndarray, k: int, m: np.ndarray, s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        apart = m - mean
        return n + k, mean + apart * (k / (n + k)), scatter + s + np.outer(apart, apart) * (n * k / (n + k))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(size), np.zeros((size, size)))
        for batch in batches:
            y = project(batch.column(0))
            if len(y):
                mean = y.mean(axis=0)
                y = y - mean
                total = joined(*total, len(y), mean, y.T @ y)
        if total[0]:
            yield from one(TaskContext.get().partitionId(), *total).to_batches()

    def fold(t: pa.Table) -> pa.Table:
        total = (0, np.zeros(size), np.zeros((size, size)))
        for i in range(len(t)):
            total = joined(*total, t["n"][i].as_py(), _doubles(t["mean"], i), _doubles(t["scatter"], i).reshape(size, size))
        return one(t["part"][0].as_py(), *total)

    r = _combined(rows.select("x").mapInArrow(read, schema), fold).first()
    return r.n, np.frombuffer(r.scatter).reshape(size, size) / r.n


@dataclass
class Whitening:
    """A fitted whitening of integer vectors of ``d`` dimensions."""

    d: int
    n: int
    sums: list[int]
    small: bool  # n * x - S and the sum of its squares fit 64 bits for every row
    eigenvalues: np.ndarray  # falling
    axes: np.ndarray  # d x kept, unit columns
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, col: pa.Array) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """x - S / n of every row, and the sum of the squares of n * x - S: exact integers (None beyond 64 bits)."""
        x = _matrix(col, self.d)
        if self.small:
            apart = self.n * x - np.array(self.sums, np.int64)
            return apart / self.n, (apart * apart).sum(axis=1)
        apart = self.n * x.astype(object) - np.array(self.sums, object)
        total = [int(t) if t < 1 << 63 else None for t in (apart * apart).sum(axis=1)]
        return (apart / self.n).astype(np.float64), total

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the deviations; NaN along axes without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.eigenvalues > 0, centred @ self.axes / np.sqrt(self.eigenvalues), np.nan)


def fit_whitening(rows: DataFrame, d: int, components: int) -> Whitening:
    """Fit on every row's integer vector ``x`` (all of ``d`` entries; one row at least)."""
    s, sums, low, high = fitted_spectrum(rows, d)
    far = [max(abs(s.n * a - t), abs(s.n * b - t)) for a, b, t in zip(low, high, sums, strict=True)]
    small = sum(x * x for x in far) < 1 << 63 and all(s.n * max(abs(a), abs(b)) < 1 << 63 and abs(t) < 1 << 63 for a, b, t in zip(low, high, sums, strict=True))
    w = Whitening(d, s.n, sums, small, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    basis = np.linalg.qr(s.vectors[:, ::-1])[0]
    _, projected = _scatter(rows, lambda col: w.centred(col)[0] @ basis, d)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    kept = min(components, d)
    trace = float(np.trace(projected))
    w.eigenvalues = values[::-1][:kept].copy()
    w.eigenvalues[w.eigenvalues <= NO_VARIANCE * trace] = 0.0
    w.axes = np.linalg.qr(basis @ turn[:, ::-1])[0][:, :kept]
    w.explained = w.eigenvalues / trace if trace > 0 else np.full(kept, np.nan)
    used = int((w.eigenvalues > 0).sum())
    if used:
        _, unit = _scatter(rows, lambda col: w.whitened(w.centred(col)[0])[:, :used], used)
        w.identity_error = float(np.abs(unit - np.eye(used)).max())
    return w


def whitened_components(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
                        scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each usable input row and component, numbered from 1 by falling eigenvalue: ``id_col``, ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    A component c of a vector counts as floor(``scale`` * c) + ``shift`` (within the range of a
    long). The fit is over all usable rows, repeated ones included. Rows whose vector is null or
    empty or holds null or non-finite entries take no part; rows without an id do, with a null id.
    Vectors of different lengths are whitened apart, each length by its own fit. There are at most
    as many components as dimensions. Along an axis without variance (eigenvalue 0 within rounding)
    ``whitened`` is null and ``explained`` 0, or null if no axis has any; ``identity_error`` is over the axes
    that have variance (null without any). ``deviation`` is null if it exceeds a long. No rows give no rows;
    extra columns are not read. Eigenvalues that are equal leave their axes free within their plane.
    """
    kind = table.schema[id_col].dataType.simpleString()
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = table.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), v.alias("v"))
    limit = float(1 << 62)
    whole = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-limit)), F.lit(limit))) + F.lit(shift).cast("long")
    rows = stored(rows.select("id", F.transform("v", whole).alias("x")), "vectors")
    lengths = [r[0] for r in rows.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()]
    out = table.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {_RESULT}")
    for d in lengths:
        part = rows.where(F.size("x") == d) if len(lengths) > 1 else rows
        one = _applied(part, fit_whitening(part, d, components), id_col, kind)
        out = one if len(lengths) == 1 else out.unionByName(one)
    return out


def _applied(rows: DataFrame, model: Whitening, id_col: str, kind: str) -> DataFrame:
    kept = len(model.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = np.where(np.isnan(model.explained), None, model.explained).tolist()
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            centred, deviation = model.centred(batch.column(1))
            y = model.whitened(centred).ravel()
            each = pa.array(np.repeat(np.arange(m), kept))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, model.n, np.int64)),
                pa.array(deviation, pa.int64()).take(each), pa.array(y, mask=np.isnan(y)), pa.array(explained * m, pa.float64()),
                pa.array([model.identity_error] * (m * kept), pa.float64())],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(apply, f"`{id_col}` {kind}, {_RESULT}")
