"""Operator 12, embedding whitening by spectrum slicing.

Vectors become integers ``floor(scale * c) + offset``.  Two passes of exact
integer sums give the mean and, from vectors centred on the whole number next to
the mean, the products of all pairs of dimensions; the fraction left is taken out
in integer arithmetic.  So every entry of the covariance is its exact value,
rounded once, however the rows are partitioned.

Leading eigenpairs of the covariance V (dimension squared, on the driver):

* Householder reflections bring V to a tridiagonal form T with the same spectrum.
  The signs of D in ``T - xI = L D L^T`` count the eigenvalues above x (Sylvester's
  law of inertia); for a tridiagonal matrix this is stable without pivoting.
* Bisection on these counts narrows one interval for each component until no
  other eigenvalue is in it, or until it is as narrow as V's rounding.
* Rayleigh quotient iteration on V itself, started inside the interval, converges
  cubically.  When it leaves the interval, the interval is narrowed further.
* Counts on both sides of each result certify its number; a failure raises.

Components with an eigenvalue of zero (to double precision: below ``d * 2e-16``
times the largest) have no whitened value and no rows.

Defined results: vectors that are null, hold null or non-finite entries, or
entries too large for a long, take no part and have no row.  All vectors have one
length; where lengths differ, those of the most frequent one (ties: the longest)
take part.  Repeated rows count as often as they come, ties of eigenvalues are
numbered in any order, null ids are ids like any other.  Empty tables, and tables
without variance, give no row.  A deviation beyond a long is null.  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Settings:
    components: int = 32
    scale: int = 64
    offset: int = 1_000_000


# --------------------------------------------------------------------- spectrum

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the spectrum of the symmetric ``v``."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm <= np.abs(x[0]):
            continue  # the rest of the column is zero
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1:, k + 1:]
        p = block @ x
        q = p - (x @ p) * x
        block -= 2 * (np.outer(x, q) + np.outer(q, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: the positive pivots of L D L^T of the shifted matrix, for all shifts at once."""
    tiny = max(EPS * EPS * float(np.abs(diagonal).max(initial=0.0)), 1e-300)
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(np.int64)
    for a, b in zip(diagonal[1:], side):
        pivot = a - shifts - b * b / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d = len(v)
    k = min(k, d)
    diagonal, side = tridiagonal(v)
    edge = np.abs(np.append(side, 0)) + np.abs(np.append(0, side))
    low, high = float((diagonal - edge).min()), float((diagonal + edge).max())  # Gershgorin
    norm = max(abs(low), abs(high))
    if norm == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    width = 8 * d * EPS * norm  # rounding of the tridiagonal form
    lo, hi, number = np.full(k, low - width), np.full(k, high + width), np.arange(1, k + 1)
    within = lambda: above(diagonal, side, lo) - above(diagonal, side, hi)

    def narrow(which: np.ndarray) -> None:
        middle = (lo + hi) / 2
        right = above(diagonal, side, middle) >= number
        lo[which & right], hi[which & ~right] = middle[which & right], middle[which & ~right]

    while (open_ := (within() > 1) & (hi - lo > width)).any():
        narrow(open_)

    rng = np.random.default_rng(0)
    values, vectors = np.zeros(k), np.zeros((d, 0))
    for j in range(k):
        this = number == j + 1
        while True:
            x, value, residual = rng.normal(size=d), np.nan, np.inf
            shift, best = (lo[j] + hi[j]) / 2, np.inf
            for step in range(12):
                x = x - vectors @ (vectors.T @ x)
                try:
                    y = np.linalg.solve(v - shift * np.eye(d), x)
                except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                    y = np.linalg.solve(v - (shift + EPS * norm) * np.eye(d), x)
                for _ in range(2):
                    y = y / np.linalg.norm(y)
                    y = y - vectors @ (vectors.T @ y)
                x = y / np.linalg.norm(y)
                value = x @ v @ x
                residual = np.linalg.norm(v @ x - value * x)
                if step > 2 and residual >= best / 2 or residual <= EPS * norm:
                    break
                best = min(best, residual)
                if step and lo[j] <= value <= hi[j]:  # the first step is an inverse iteration at the middle
                    shift = value
            if lo[j] - width <= value <= hi[j] + width and residual <= 64 * d * EPS * norm:
                break
            if hi[j] - lo[j] <= width:
                raise ArithmeticError(f"no eigenvector for component {j + 1}")
            for _ in range(4):
                narrow(this)
        values[j], vectors = value, np.column_stack([vectors, x])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    if not ((above(diagonal, side, values + width) < number) & (above(diagonal, side, values - width) >= number)).all():
        raise ArithmeticError("the counts contradict the components' numbers")
    return values, vectors


# ------------------------------------------------------------------- exact sums

def _matrix(batch: pa.RecordBatch, s: Settings) -> np.ndarray:
    """The integer vectors of a batch without nulls and of one length, as rows."""
    column = batch.column("v")
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(s.scale * flat).astype(np.int64).reshape(len(column), -1) + s.offset


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums as Python integers."""
    return (x if _largest(x) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)


def products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y`` as Python integers: products of doubles as long as every sum fits their 53 bits."""
    largest, total = _largest(y), np.zeros((y.shape[1],) * 2, object)
    rows = len(y) if not largest else (1 << 53) // (largest * largest)
    if not rows:
        return y.astype(object).T @ y.astype(object)
    for lo in range(0, len(y), rows):
        part = y[lo:lo + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * y - rest) ** 2`` of every row, exactly; null beyond a long."""
    bound = n * _largest(y) + max(map(abs, rest), default=0)
    if bound * bound * max(1, y.shape[1]) < 1 << 63:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
    return [e if e < 1 << 63 else None for e in exact]


def _totals(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], exact: bool) -> dict[tuple[int, int], object]:
    """Sums over all batches of a matrix each gives (only the upper triangle of a square one); at most its size reaches the driver."""
    kind, arrow = ("decimal(38,0)", pa.decimal128(38, 0)) if exact else ("double", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = partial(batch) if total is None else total + partial(batch)
        if total is not None:
            i, j = np.triu_indices(len(total)) if total.shape[0] == total.shape[1] else np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([_number(x, exact) for x in total[i, j]], arrow)], names=["i", "j", "x"])

    sums = rows.mapInArrow(run, f"i int, j int, x {kind}").groupBy("i", "j").agg(F.sum("x").alias("x"))
    return {(r.i, r.j): int(r.x) if exact else r.x for r in sums.collect()}


def _number(x, exact: bool):
    from decimal import Decimal

    return Decimal(int(x)) if exact else float(x)


# --------------------------------------------------------------------- operator

def usable(vector: Column, scale: int) -> Column:
    """Whether a vector and all its entries are there, finite, and within a long when scaled."""
    bound = float(1 << 61) / scale
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < bound))


@dataclass(frozen=True)
class Fit:
    n: int
    centre: tuple[int, ...]     # whole numbers next to the mean
    rest: tuple[int, ...]       # sums of the vectors less the centre
    values: np.ndarray          # eigenvalues, falling, all above zero
    vectors: np.ndarray         # (dimensions, components)
    trace: float
    settings: Settings

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Centred integer vectors projected on the components, in units of their standard deviation."""
        return (y - np.array([r / self.n for r in self.rest])) @ self.vectors / np.sqrt(self.values)


def _rows(df: DataFrame, id_: str, vector: str, s: Settings) -> tuple[DataFrame, int]:
    v = F.col(f"`{vector}`")
    rows = df.where(usable(v, s.scale)).select(F.col(f"`{id_}`").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = 0 if size is None else size["size"]
    return rows.where(F.size("v") == width), width


def fit(rows: DataFrame, width: int, s: Settings = Settings()) -> Fit | None:
    """Exact covariance of all rows (id, v) and its leading components; None without variance."""
    if not width:
        return None
    first = _totals(rows.select("v"), lambda b: np.append(column_sums(x := _matrix(b, s)), len(x)).reshape(1, -1), True)
    n, sums = first[0, width], [first[0, i] for i in range(width)]
    centre = tuple((2 * t + n) // (2 * n) for t in sums)
    rest = tuple(t - n * c for t, c in zip(sums, centre))
    middle = np.array(centre, np.int64)
    second = _totals(rows.select("v"), lambda b: products(_matrix(b, s) - middle), True)
    v = np.zeros((width, width))
    trace = 0
    for (i, j), g in second.items():
        top = n * g - rest[i] * rest[j]
        v[i, j] = v[j, i] = top / (n * n)
        trace += top if i == j else 0
    if not trace:
        return None
    values, vectors = leading(v, s.components)
    real = values > width * EPS * values[0]
    return Fit(n, centre, rest, values[real], vectors[:, real], trace / (n * n), s)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""
    s, middle = model.settings, np.array(model.centre, np.int64)
    k = len(model.values)
    w = lambda b: model.whitened((_matrix(b, s) - middle).astype(np.float64))
    sums = _totals(rows.select("v"), lambda b: np.append(w(b).sum(axis=0), 0).reshape(1, -1), False)
    mean = np.array([sums[0, i] for i in range(k)]) / model.n
    found = _totals(rows.select("v"), lambda b: (c := w(b) - mean).T @ c, False)
    return max(abs(x / model.n - (i == j)) for (i, j), x in found.items())


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    rows, width = _rows(df, id_, vector, settings)
    model = fit(rows, width, settings)
    schema = T.StructType([T.StructField("vec_id", df.schema[id_].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    middle, k = np.array(model.centre, np.int64), len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                y = _matrix(batch, settings) - middle
                m = len(y)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(y, model.n, list(model.rest)), pa.int64()).take(each), pa.array(model.whitened(y.astype(np.float64)).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
