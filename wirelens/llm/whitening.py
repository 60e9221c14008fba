"""Principal components and whitening by spectrum slicing.

Spark sums the exact covariance of all distinct vectors: components are whole numbers, taken less a whole number near
their mean before they are multiplied, and summed as integers, so neither order nor size of the parts changes a digit.
The matrix that results has the square of a vector's length and is solved where the plan is made: the signs of D in
the factors LDL^T of ``V - s`` count the eigenvalues below ``s`` (inertia), halving intervals by these counts isolates
each leading eigenvalue, Rayleigh quotients converge to it from there with the third power, and counts on either side
of the result certify its number. Eigenvalues too close to be told apart share an interval and are solved together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import columns as C

LONG = (1 << 63) - 1
EXACT = 1 << 53
#: Growth bound of pivoted factors (the choice of Bunch and Kaufman).
ALPHA = (1 + math.sqrt(17)) / 8


# -- the spectrum of a symmetric matrix


def inertia(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``a`` below ``shift``: negative pivots of pivoted LDL^T of ``a - shift``."""
    m = a - shift * np.eye(len(a))
    tiny, below, k = np.finfo(float).eps * max(np.abs(a).max(initial=0), abs(shift), 1e-300), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < len(m):
        column = np.abs(m[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = column.max(initial=0.0)
        step = 1
        if abs(m[k, k]) < ALPHA * most:
            others = np.abs(m[k:, r]).copy()
            others[r - k] = 0
            reach = others.max()
            if abs(m[k, k]) * reach >= ALPHA * most * most:
                pass
            elif abs(m[r, r]) >= ALPHA * reach:
                swap(k, r)
            else:
                swap(k + 1, r)
                step = 2
        rest = slice(k + step, None)
        if step == 1:
            pivot = m[k, k] if abs(m[k, k]) > tiny else tiny  # an eigenvalue at the shift counts as not below it
            below += pivot < 0
            m[rest, rest] -= np.outer(m[rest, k], m[rest, k] / pivot)
        else:
            block = m[k:k + 2, k:k + 2].copy()
            below += 1 if block[0, 0] * block[1, 1] < block[0, 1] ** 2 else 2 * (block[0, 0] < 0)
            m[rest, rest] -= m[rest, k:k + 2] @ np.linalg.solve(block, m[k:k + 2, rest])
        k += step
    return int(below)


def isolate(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals with the number of eigenvalues in each, from above, which hold the ``wanted`` largest ones."""
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    least = 64 * np.finfo(float).eps * max(abs(low), abs(high))
    low, high = low - least, high + least
    open_, done = [(low, high, inertia(a, low), inertia(a, high))], []
    while open_ and sum(n for _, _, n in done) < wanted:
        low, high, under, upto = open_.pop()
        if upto == under:
            continue
        if upto - under == 1 and high - low < 0.01 * abs(high) or high - low <= least:
            done.append((low, high, upto - under))
            continue
        middle = (low + high) / 2
        at = inertia(a, middle)
        open_ += [(low, middle, under, at), (middle, high, at, upto)]
    return done


def _solve(a: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), right)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a - (shift + np.finfo(float).eps * np.abs(a).max()) * np.eye(len(a)), right)


def rayleigh(a: np.ndarray, low: float, high: float, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenvalues in an interval, falling, and their vectors (columns), at right angles to ``known``.

    One eigenvalue: inverse steps at the middle, then Rayleigh quotients. Several in one interval: inverse steps with as
    many vectors, and the quotient's matrix.
    """
    x = np.random.default_rng(len(a)).standard_normal((len(a), n))
    shift, scale = (low + high) / 2, max(np.abs(a).max(), 1e-300)
    value = np.full(n, shift)
    for step in range(60):
        x = _solve(a, shift, x - known @ (known.T @ x))
        for _ in range(2):
            x = np.linalg.qr(x - known @ (known.T @ x))[0]
        quotient, turn = np.linalg.eigh(x.T @ a @ x)
        value, x = quotient[::-1], x @ turn[:, ::-1]
        if np.abs(a @ x - x * value).max() <= 8 * np.finfo(float).eps * scale:
            break
        if n == 1 and step and low <= value[0] <= high:
            shift = float(value[0])
    return value, x


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    certified: bool  # counts of eigenvalues on both sides of every value agree with its number


def leading(a: np.ndarray, wanted: int) -> Spectrum:
    """The largest eigenvalues of a symmetric matrix with unit vectors, at most ``wanted`` and none at or below rounding."""
    size = len(a)
    if not size or not wanted or not np.abs(a).max():
        return Spectrum(np.zeros(0), np.zeros((size, 0)), True)
    values, vectors = np.zeros(0), np.zeros((size, 0))
    least = 64 * np.finfo(float).eps * np.abs(a).sum(axis=1).max()
    for low, high, n in isolate(a, min(wanted, size)):
        value, x = rayleigh(a, low, high, n, vectors)
        while n == 1 and not low - least <= value[0] <= high + least and high - low > least:  # it went to a close one outside
            middle = (low + high) / 2
            low, high = (middle, high) if inertia(a, middle) == inertia(a, low) else (low, middle)
            value, x = rayleigh(a, low, high, n, vectors)
        values, vectors = np.append(values, value), np.column_stack([vectors, x])
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    real = values > size * np.finfo(float).eps * np.trace(a)
    values, vectors = values[real], vectors[:, real]
    near = 64 * np.finfo(float).eps * np.abs(a).max() * math.sqrt(size)
    certified = all(size - inertia(a, v + near) <= i < size - inertia(a, v - near) for i, v in enumerate(values))
    return Spectrum(values, vectors, certified)


# -- sums over all rows


def grid(table: DataFrame, *, vector: str = "embedding", key: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """key and x, the components as floor(scale * c) + offset, of the rows whose vector is whole and finite.

    Repeated rows and rows without a key stay. Values of scale * c beyond 2**53 count as that number.
    """
    c = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = F.col(vector).isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    end = F.lit(float(EXACT))
    whole = F.transform(c, lambda e: F.floor(F.greatest(-end, F.least(end, e * scale))).cast("long") + offset)
    return table.where(good).select(F.col(key).alias(key), whole.alias("x"))


def _whole(lists: pa.Array, width: int, centre: np.ndarray, missing: int) -> np.ndarray:
    """Rows less ``centre``; what a shorter vector lacks counts as ``missing``."""
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    out = np.full((len(lists), width), missing, np.int64)
    rows = np.repeat(np.arange(len(lists)), counts)
    out[rows, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out - centre


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of y_i * y_j over the rows, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _summed(rows: DataFrame, width: int, centre: np.ndarray, missing: int) -> tuple[list[int], np.ndarray]:
    """Sums and products of all rows less ``centre``; tasks add up their own, Spark adds theirs up by place."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((width, width), object), np.zeros(width, object)
        for part in batches:
            y = _whole(part.column("x"), width, centre, missing)
            total += products(y)
            first += y.sum(axis=0).astype(object) if int(np.abs(y).max(initial=0)) * len(y) < LONG else y.astype(object).sum(axis=0)
        i, j = np.triu_indices(width)
        sums = [Decimal(int(v)) for v in (*total[i, j], *first)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, np.arange(width)], pa.int32()), pa.array(np.r_[j, np.full(width, -1)], pa.int32()),
                                          pa.array(sums, pa.decimal128(38, 0))], names=["i", "j", "s"])

    square, first = np.zeros((width, width), object), [0] * width
    for r in rows.mapInArrow(task, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r.j < 0:
            first[r.i] = int(r.s)
        else:
            square[r.i, r.j] = square[r.j, r.i] = int(r.s)
    return first, square


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into its whitened components."""

    n: int
    offset: int
    centre: np.ndarray  # whole number near the mean of each dimension
    rest: list[int]  # sums over the fit list, less n times the centre
    trace: float
    spectrum: Spectrum

    @property
    def sums(self) -> list[int]:
        return [r + self.n * int(c) for r, c in zip(self.rest, self.centre)]

    def centred(self, lists: pa.Array) -> np.ndarray:
        return _whole(lists, len(self.centre), self.centre, self.offset)

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y - np.array([r / self.n for r in self.rest])) @ (self.spectrum.vectors / np.sqrt(self.spectrum.values))

    def deviation(self, y: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - S)**2; the largest long where it is more."""
        most = max(int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.rest), default=0), 0)
        if most * most * max(1, y.shape[1]) < LONG:
            d = y * self.n - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1)
        d = y.astype(object) * self.n - np.array(self.rest, object)
        return np.array([min(LONG, sum(int(v) ** 2 for v in row)) for row in d], np.int64)


def fit(distinct: DataFrame, *, components: int, offset: int = 1_000_000) -> Whitening | None:
    """Components of the covariance (divisor n) of the rows of ``distinct`` (column x, each vector once); None if empty."""
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None
    near = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg((F.sum(F.col("v").cast("double") - offset) / n).alias("m")).collect()
    centre = np.full(width, offset, np.int64)
    for r in near:  # any whole number near the mean will do, so this sum need not be exact
        centre[r.d] = offset + round(r.m)
    first, square = _summed(distinct, width, centre, offset)
    v = np.array([[(n * int(square[i, j]) - first[i] * first[j]) / (n * n) for j in range(width)] for i in range(width)]).reshape(width, width)
    return Whitening(int(n), offset, centre, first, float(np.trace(v)), leading(v, components))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; one sum over all of it."""
    k = len(model.spectrum.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for part in batches:
            w = model.project(model.centred(part.column("x")))
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((k, k + 1))
    for r in distinct.mapInArrow(task, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, *, components: int = 16, key: str = "vec_id", offset: int = 1_000_000) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error, certified for every row and component.

    ``certified``: counts of eigenvalues on both sides of every component's value agree with its number.

    ``rows`` as from ``grid``. The fit list is every distinct x once; fewer components than wanted exist where the
    vectors are short or their covariance has no more above rounding (none for equal vectors: no rows). A shorter vector
    counts as filled up with ``offset``, the x of zero, and is the same vector as the filled one. Repeated rows give
    repeated results, a null key stays null.
    """
    spark = C.session(rows.sparkSession)
    shape = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, certified boolean"
    rows = C.stored(rows)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x")))
    distinct = C.stored(rows.select(filled.alias("x")).distinct())
    model = fit(distinct, components=components, offset=offset)
    k = len(model.spectrum.values) if model else 0
    if not k:
        return spark.createDataFrame([], shape)
    error, part_of = identity_error(distinct, model), model.spectrum.values / model.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            y = model.centred(part.column("x"))
            m = part.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                part.column(key).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                pa.array(model.deviation(y)[each]), pa.array(model.project(y).ravel()), pa.array(np.tile(part_of, m)), pa.array(np.full(m * k, error)),
                pa.array(np.full(m * k, model.spectrum.certified)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "certified"])

    return rows.mapInArrow(task, shape)
