"""Embedding whitening from an exact integer scatter.

A vector's entries become integers, ``floor(256 * c)``. The fit list has each distinct
integer vector once. Its count n, its sums S and its cross-products are gathered exactly:
a task subtracts a shift (its first vector), cuts what is left into limbs of 22 bits,
whose products over 512 rows are exact in doubles, adds them up in integers of any
length and takes the shift out again. n XᵀX - S Sᵀ follows exactly, and only then becomes
floating point, divided by n², for ``eigh``. No cancellation happens in doubles, whatever
the offset or the order of the rows, and a task that runs again gives the same sums.

The driver gets a number for each pair of dimensions, never a row; the tasks get
d x k numbers back. The fit list is a written table, as two passes read it.

Defined results for odd rows: a null vector, or one with a null or non-finite entry, is
dropped; so is one whose length isn't the commonest among the others (of two as common, the
longer). Integers beyond 64 bits are held at the ends of their range. Repeated rows all get
results, though they count once in the fit. A component without variance has null
whitened values and stays out of the identity error; a deviation over 64 bits is null. An
empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import free_name, prepared, split_batch, written

#: Factor before rounding down; components kept.
SCALE, COMPONENTS = 256, 4
#: Bits of a limb, rows whose limbs' products are summed at once (2 * 22 + 9 = 53 bits), and such sums that 64 bits hold.
LIMB, ROWS, BLOCKS = 22, 512, 512
#: Bits of the digits in which sums of any length leave a task.
DIGIT = 32


@dataclass(frozen=True)
class Whitening:
    """n, S (Python integers), and of each component the value, the unit vector (columns) and the share of the trace."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    usable: np.ndarray
    identity_error: float | None


def integers(vec_col: str, scale: int = SCALE) -> Column:
    """The vector as longs; null where it isn't whole and finite."""
    v = f"cast(`{vec_col}` AS array<double>)"
    bad = f"exists({v}, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))"
    return F.expr(f"CASE WHEN `{vec_col}` IS NOT NULL AND NOT coalesce({bad}, false) THEN transform({v}, c -> floor(c * {scale}D)) END")


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """int64 as doubles, one array a limb; the last is signed."""
    out = []
    while x.size and (x.min() < -(1 << LIMB) or x.max() >= 1 << LIMB):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


class Scatter:
    """Exact count, sums and cross-products of integer vectors."""

    def __init__(self, dims: int):
        self.n, self.shift, self.dims = 0, None, dims
        self.sums, self.products = np.zeros(dims, object), np.zeros((dims, dims), object)
        self.open: dict[tuple[int, int], np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        if self.shift is None:
            self.shift = np.where(np.abs(x[0].astype(np.float64)) < 2.0**61, x[0], 0)
        small = np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61
        shift = self.shift if small else np.zeros_like(self.shift)
        n, sums, products = len(x), np.zeros(self.dims, object), None
        for at in range(0, n, ROWS):
            limbs = _limbs(x[at : at + ROWS] - shift)
            sums += sum((part.sum(0).astype(np.int64).astype(object) << (LIMB * k)) for k, part in enumerate(limbs))
            if not small:  # rare: nothing is shifted, so these go to sums of their own
                products = (0 if products is None else products) + sum((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)) for i, a in enumerate(limbs) for j, b in enumerate(limbs))
                continue
            for i, a in enumerate(limbs):
                for j, b in enumerate(limbs):
                    part = (a.T @ b).astype(np.int64)
                    self.open[i, j] = self.open[i, j] + part if (i, j) in self.open else part
            self.blocks += 1
            if self.blocks == BLOCKS:
                self._close()
        if products is not None:
            self.products += products
        else:  # (y + c)(y + c)ᵀ = y yᵀ + y cᵀ + c yᵀ + c cᵀ; y yᵀ comes from the open sums
            c = shift.astype(object)
            self.products += np.outer(sums, c) + np.outer(c, sums) + n * np.outer(c, c)
        self.sums += sums + n * shift.astype(object)
        self.n += n

    def _close(self) -> None:
        for (i, j), part in self.open.items():
            self.products += part.astype(object) << (LIMB * (i + j))
        self.open, self.blocks = {}, 0

    def rows(self):
        """``i, j, digit, value``: cross-products, the sums with i = -1, the count with i = j = -1."""
        self._close()
        yield from _digits(-1, -1, self.n)
        for j in range(self.dims):
            yield from _digits(-1, j, int(self.sums[j]))
            for i in range(j + 1):
                yield from _digits(i, j, int(self.products[i, j]))


def _digits(i: int, j: int, value: int):
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield i, j, k, sign * (value & ((1 << DIGIT) - 1))
        value, k = value >> DIGIT, k + 1


def _matrix(column, dims: int) -> np.ndarray:
    """A batch's list column as rows of int64."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _gathered(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and XᵀX of the table ``fit(x)`` as Python integers."""

    def run(batches):
        total = Scatter(dims)
        for batch in batches:
            total.add(_matrix(batch.column(0), dims))
        if total.n:
            i, j, digit, value = zip(*total.rows(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(digit, pa.int32()), pa.array(value, pa.int64())], ["i", "j", "digit", "value"])

    parts = fit.mapInArrow(run, "i int, j int, digit int, value long")
    sums: dict[tuple[int, int], int] = {}
    for i, j, digit, value in parts.groupBy("i", "j", "digit").agg(F.sum("value")).collect():  # a row for each pair of dimensions and digit
        sums[i, j] = sums.get((i, j), 0) + (value << (DIGIT * digit))
    s = np.array([sums.get((-1, j), 0) for j in range(dims)], object)
    x = np.array([[sums.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)], object)
    return sums.get((-1, -1), 0), s, x.reshape(dims, dims)


def dimension(df: DataFrame, x_col: str) -> int | None:
    """The commonest length of the integer vectors; of two as common, the longer."""
    most = df.where(F.col(x_col).isNotNull()).groupBy(F.size(x_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most and most[0]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The components of the distinct integer vectors; None where there is none."""
    prepared(vectors.sparkSession)
    whole = vectors.select(integers(vec_col, scale).alias("x")).where("x IS NOT NULL")
    dims = dimension(whole, "x")
    if not dims:
        return None
    fit_list = written(whole.where(F.size("x") == dims).distinct(), "whitening-fit")
    n, s, x = _gathered(fit_list, dims)
    scatter = n * x - np.outer(s, s)  # exact
    covariance = np.array([[v / (n * n) for v in row] for row in scatter], np.float64)  # an int divided by an int is rounded once
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1][:components].copy(), vectors_[:, ::-1][:, :components].copy()
    vectors_ *= np.where(vectors_[np.abs(vectors_).argmax(0), np.arange(vectors_.shape[1])] < 0, -1.0, 1.0)
    trace = float(sum(scatter[i, i] for i in range(dims)) / (n * n))
    usable = values > max(values[0], 0) * dims * np.finfo(float).eps
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    model = Whitening(n, tuple(s), values, vectors_, explained, usable, None)
    return Whitening(n, tuple(s), values, vectors_, explained, usable, _identity_error(fit_list, model))


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """The largest entry of |covariance of the whitened fit list - identity| over the usable components."""
    keep = np.flatnonzero(model.usable)
    k, dims = len(keep), len(model.sums)
    if not k:
        return None

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(_matrix(batch.column(0), dims), model)[0][:, keep]
            one, two = one + w.sum(0), two + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array([*one, *two.ravel()], pa.float64())], ["at", "value"])

    sums = dict(map(tuple, fit_list.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect()))  # k + k² rows
    mean = np.array([sums[i] for i in range(k)]) / model.n
    covariance = np.array([sums[k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list]:
    """Whitened values (rows by components) and exact deviations of integer vectors."""
    s, n = model.sums, model.n
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max((abs(v) for v in s), default=0)
    if most < 1 << 62:
        d = x * n - np.array(s, np.int64)
        deviation = (d * d).sum(1).tolist() if most * most * max(1, len(s)) < 1 << 62 else [sum(v * v for v in row) for row in d.tolist()]
    else:
        d = x.astype(object) * n - np.array(s, object)
        deviation = [sum(v * v for v in row) for row in d.tolist()]
    centred = (d / n).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        whitened = centred @ model.vectors / np.sqrt(model.values)
    return whitened, [v if v < 1 << 63 else None for v in deviation]


def whiten(df: DataFrame, model: Whitening | None, vec_col: str = "embedding", out_col: str = "whitened", deviation_col: str = "deviation", scale: int = SCALE) -> DataFrame:
    """The rows with a usable vector, with ``out_col`` (array of double, a value a component) and ``deviation_col``
    in place of any columns of those names."""
    x_col = free_name(df, "__x")
    keyed = df.withColumn(x_col, integers(vec_col, scale))
    plain = keyed.drop(out_col, deviation_col)
    schema = plain.drop(x_col).select("*", F.array(F.lit(0.0)).alias(out_col), F.lit(0).cast("long").alias(deviation_col)).schema
    schema = StructType([StructField(f.name, ArrayType(DoubleType()) if f.name == out_col else f.dataType) for f in schema])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    prepared(df.sparkSession)
    dims, at, width = len(model.sums), plain.columns.index(x_col), len(plain.columns)

    def run(batches):
        for whole in batches:
            for batch in split_batch(whole):
                w, deviation = project(_matrix(batch.column(at), dims), model)
                w = [[v if ok else None for v, ok in zip(row, model.usable, strict=True)] for row in w.tolist()]
                rest = [batch.column(i) for i in range(width) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(w, pa.list_(pa.float64())), pa.array(deviation, pa.int64())], names=schema.names)

    return plain.where(F.col(x_col).isNotNull() & (F.size(x_col) == dims)).mapInArrow(run, schema)
