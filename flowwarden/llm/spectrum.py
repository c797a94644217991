"""Whitening of embeddings by spectrum slicing.

Spark sums the vectors and then their centred products; only those sums, as large as the
dimensions squared, reach the driver. There the leading eigenvalues of the covariance are found
one by one. The LDL' factors of the covariance less a shift have as many positive pivots as
eigenvalues lie above the shift (Sylvester), so halving an interval isolates each. Rayleigh
quotient iteration starts from the middle of its interval and converges cubically; a quotient
that leaves the interval halves it again. At last counts just above and below each value
certify its number. The vectors are projected in a last pass.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Tables of sums that one task adds up.
_FAN = 64
_EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this, relative to the largest, are made orthogonal to each other.
_CLOSE = 1e-3


# ---- the matrix ----


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``: the positive pivots of LDL'
    with 1 x 1 and 2 x 2 pivots, chosen so that no factor grows much (Bunch and Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = _EPS * max(float(np.abs(a).max()), sys.float_info.min)
    ratio, above, k, n = (1 + 17**0.5) / 8, 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        size = 1
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax()) + k + 1
            largest = column[r - k - 1]
            if abs(a[k, k]) < ratio * largest:
                others = np.abs(a[k:, r])
                others[r - k] = 0
                if abs(a[k, k]) * others.max() < ratio * largest * largest:
                    if abs(a[r, r]) >= ratio * others.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
        if size == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny else -tiny  # on an eigenvalue: not above it
            above += int(pivot > 0)
            rest = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(rest / pivot, rest)
        else:
            block, rest = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            above += 1  # chosen so that its determinant is negative: one pivot of each sign
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        k += size
    return above


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues, falling, and unit eigenvectors as rows."""

    values: np.ndarray
    vectors: np.ndarray


def _isolated(count: Callable[[float], int], low: float, high: float, n: int, width: float):
    """Intervals (low, high, first, last), from the top: eigenvalues number first to last, counted
    from 0, lie above low and not above high. Each holds one, or several in less than ``width``."""
    found, open_ = [], [(low, high, count(low), count(high))]
    while open_:
        a, b, over_a, over_b = open_.pop()
        if over_a == over_b or over_b >= n:
            continue
        middle = (a + b) / 2
        if over_a - over_b == 1 or b - a <= width or not a < middle < b:
            found.append((a, b, over_b, over_a - 1))
            continue
        over = count(middle)
        open_ += [(a, middle, over_a, over), (middle, b, over, over_b)]
    return sorted(found, key=lambda x: x[2])


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, unit: float) -> np.ndarray:
    for step in (0.0, 1.0, 4.0):  # exactly singular: shift by the rounding of the values
        try:
            w = np.linalg.solve(matrix - (shift + step * unit) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and w.any():
            return w
    return v


def _without(w: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            w = w - (u @ w) * u
    return w / np.linalg.norm(w)


def _refined(matrix, count, a, b, number, near, seed, unit):
    """Eigenvalue ``number``, alone between a and b, and its vector. Vectors of close values are
    kept out: a wandering iteration would find them again."""
    v = _without(np.random.default_rng(seed).normal(size=len(matrix)), near)
    shift, best = (a + b) / 2, None
    for turn in range(200):
        v = _without(_solved(matrix, shift, v, unit), near)
        value = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - value * v))
        if a - unit <= value <= b + unit and (best is None or rest < best[0]):
            best = (rest, value, v)
        if best and best[0] <= unit and (rest >= best[0] / 2 or turn > 20):
            return best[1], best[2]
        if turn >= 2 and a < value < b and rest < (b - a) / 2:
            shift = value  # cubic from here on
            continue
        if (b - a) > 4 * unit and turn % 3 == 2:  # another value is as near: halve the interval
            middle = (a + b) / 2
            a, b = (middle, b) if count(middle) > number else (a, middle)
        shift = (a + b) / 2
    raise ArithmeticError(f"eigenvalue {number + 1} did not converge")


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> Spectrum:
    """The largest eigenvalues of a covariance, at most ``components``, and their vectors. Values
    that rounding can't tell from zero are left out. Equal values get some orthonormal basis."""
    n = len(matrix)
    radius = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not radius > 0:
        return Spectrum(np.zeros(0), np.zeros((0, n)))
    unit = 4 * _EPS * radius
    seen: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in seen:
            seen[shift] = inertia(matrix, shift)
        return seen[shift]

    low, high = n * unit, radius + unit
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for a, b, first, last in _isolated(count, low, high, components, 16 * unit):
        for number in range(first, min(last, components - 1) + 1):
            near = [u for e, u in zip(values, vectors, strict=True) if e - b <= _CLOSE * radius]
            if last > first:  # values equal to rounding: inverse iteration, one after the other
                v = np.random.default_rng(number).normal(size=n)
                for _ in range(4):
                    v = _without(_solved(matrix, (a + b) / 2, v, unit), near)
                value = float(v @ matrix @ v)
            else:
                value, v = _refined(matrix, count, a, b, number, near, number, unit)
            edge = max(4 * float(np.linalg.norm(matrix @ v - value * v)), 8 * unit) + (b - a if last > first else 0)
            if count(value - edge) <= number or count(value + edge) > number:
                raise ArithmeticError(f"eigenvalue {number + 1} is not certified by its counts")
            values.append(value)
            vectors.append(v)
    order = np.argsort(-np.array(values), kind="stable")
    return Spectrum(np.array(values)[order], np.array(vectors).reshape(-1, n)[order])


# ---- the table ----


def _entries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= sys.float_info.max, F.lit(False)))
    rows = df.where(F.coalesce((F.size(x) > 0) & fine, F.lit(False)))
    return rows.select(F.col(id_col).alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def _whole(column: pa.Array) -> np.ndarray:
    """floor(64 * c) + 1000000 of a batch's vectors, as longs."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * column.flatten().to_numpy().reshape(len(column), -1))
    if not (np.abs(x) < 2.0**62).all():
        raise OverflowError("a component times 64 does not fit a long")
    return x.astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and exact sums by dimension of one task's vectors."""
    n, total = 0, None
    for batch in batches:
        x = _whole(batch.column(0))
        if not len(x):
            continue
        if float(np.abs(x).max()) * len(x) >= 2.0**62:
            x = x.astype(object)
        part = np.array([int(s) for s in x.sum(axis=0)], object)
        n, total = n + len(x), part if total is None else total + part
    if n:
        sums = pa.array([[Decimal(s) for s in total]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), sums], ["n", "sums"])


def _added(parts: DataFrame) -> np.ndarray:
    """Sum of tables of doubles, one row a task, in levels of ``_FAN``: no task and not the
    driver holds more than one sum and the row it adds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                found = np.frombuffer(value.as_buffer())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = stored(parts, "sums")
    while (n := parts.count()) > _FAN:
        dealt = parts.select("part").repartition(-(-n // _FAN), "part")
        parts = stored(dealt.mapInArrow(work, "part binary"), "sums")
    rows = [np.frombuffer(r["part"]) for r in parts.select("part").collect()]  # at most _FAN
    return np.sum(rows, axis=0) if rows else np.zeros(0)


def _products(rows: DataFrame, value: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum of v v' over the rows, v made from a vector by ``value``, and behind it that of v."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = value(batch.column(0))
            part = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            task = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), task], ["part", "task"])

    return _added(rows.select("v").mapInArrow(work, "part binary, task long"))


@dataclass(frozen=True)
class Whitening:
    """What a table's vectors are projected by."""

    n: int
    sums: list[int]
    trace: float
    spectrum: Spectrum

    def centred(self, column: pa.Array) -> np.ndarray:
        """x - S/n: first the whole part of S/n, exactly, then the rest."""
        floor = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s - self.n * f, self.n)) for s, f in zip(self.sums, floor, strict=True)])
        return (_whole(column) - np.array(floor, np.int64)) - rest

    def projected(self, column: pa.Array) -> np.ndarray:
        return self.centred(column) @ self.spectrum.vectors.T / np.sqrt(self.spectrum.values)

    def deviations(self, column: pa.Array) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        x, rest = _whole(column) - floor, np.array([s % self.n for s in self.sums], np.int64)
        if not len(x):
            return []
        if (float(np.abs(x).max()) + 1) * self.n * (x.shape[1] ** 0.5) >= 2.0**31:
            x, rest = x.astype(object), rest.astype(object)
        y = self.n * x - rest
        return [int(s) for s in (y * y).sum(axis=1)]


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None where there are none. Vectors of different
    length are an error: they have no covariance."""
    rows = _entries(df, id_col, vec_col)
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] is None:
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    parts = stored(rows.select("v").mapInArrow(_sums, "n long, sums array<decimal(38,0)>"), "sums")
    n = parts.agg(F.sum("n")).first()[0]
    total = parts.select(F.posexplode("sums").alias("dimension", "s")).groupBy("dimension").agg(F.sum("s").alias("s"))
    sums = [int(r["s"]) for r in sorted(total.collect(), key=lambda r: r["dimension"])]  # one row a dimension
    centre = Whitening(n, sums, 0.0, Spectrum(np.zeros(0), np.zeros((0, len(sums)))))
    covariance = _products(rows, centre.centred)[: len(sums) ** 2].reshape(len(sums), -1) / n
    covariance = (covariance + covariance.T) / 2
    return Whitening(n, sums, float(np.trace(covariance)), leading(covariance, components))


def identity_error(df: DataFrame, found: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance, about their own means, less
    the identity."""
    k = len(found.spectrum.values)
    if not k:
        return 0.0
    rows = _entries(df, id_col, vec_col)
    mean = _products(rows, found.projected)[k * k :] / found.n
    covariance = _products(rows, lambda column: found.projected(column) - mean)[: k * k].reshape(k, k) / found.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """id_col, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and
    identity_error, for every usable vector and each of the leading components.

    Rows whose vector is null, empty or holds a null or non-finite component are left out;
    repeated rows and rows without an id take part. There are as many components as the data
    have directions with spread, at most ``components``: none for an empty table or where all
    vectors are equal. deviation is a decimal(38,0); entries that don't fit a long when scaled
    and vectors of different length are errors. Other columns don't matter.
    """
    rows = _entries(df, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    kinds = (
        f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    found = fit(df, id_col, vec_col, components)
    error = identity_error(df, found, id_col, vec_col) if found else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.spectrum.values) if found else 0
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 2048):
                part = batch.slice(at, 2048)
                m = part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array([Decimal(d) for d in found.deviations(part.column(1))], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n)), deviation.take(each),
                        pa.array(found.projected(part.column(1)).ravel()),
                        pa.array(np.tile(found.spectrum.values / found.trace, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, kinds).withColumnRenamed("id", id_col)
