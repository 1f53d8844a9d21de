"""Feature tables at scale: quantile grids, categorical plans, smoothed singular vectors."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..shared import written
from .algorithms import aggregate_neighbours
from .links import node_degrees
from .meeting import gathered
from .scans import value_prefix

# Quantile grid.

#: Deviation of the jitter of the fit (``samplers.normal``), and how near to the ends of the grid a value counts as the end.
JITTER, EDGE = 1e-5, 1e-7
#: Acklam's rational approximation of the inverse normal distribution (relative error under 1.2e-9):
#: numerator and denominator of the middle and of the tails, highest power first, and where the lower tail ends.
_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
_LOW = 0.02425


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p, 0 < p < 1."""
    q = p - 0.5
    r = q * q
    middle = _polynomial(r, _MIDDLE[0]) * q / _polynomial(r, _MIDDLE[1])

    def tail(x: Column) -> Column:
        s = F.sqrt(-2 * F.log(x))
        return _polynomial(s, _TAIL[0]) / _polynomial(s, _TAIL[1])

    return F.when(p < _LOW, tail(p)).when(p > 1 - _LOW, -tail(1 - p)).otherwise(middle)


def knots(rows: int) -> int:
    """Fixed rule: points of the grid for so many rows."""
    return min(max(min(rows // 30, 1000), 10), max(rows, 1))


def quantile_grid(df: DataFrame, column: str, jitter: Column | None = None) -> DataFrame:
    """One row ``grid``: the values (with ``jitter`` added) at evenly spread quantiles, between neighbours in proportion.

    The order statistics come from sums of counts over ranges of values: no task sorts or holds all values.
    """
    x = df.select((F.col(column).cast("double") + (F.lit(0.0) if jitter is None else jitter)).alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    x = written(x, "grid-values")
    n = x.count()
    k = knots(n)
    upto = value_prefix(x, "x", {"upto": F.count("*")})
    own = x.groupBy("x").agg(F.count("*").alias("own")).join(upto, "x").select("x", (F.col("upto") - F.col("own")).alias("before"), "upto")
    if n < 2:
        return x.agg(F.array(F.max("x")).alias("grid"))
    step = (n - 1) / (k - 1)
    # the grid points whose place or the place behind it falls into [before, upto)
    around = F.sequence(F.greatest(F.floor((F.col("before") - 1) / step), F.lit(0)), F.least(F.ceil(F.col("upto") / step), F.lit(k - 1)))
    near = own.select("x", "before", "upto", F.explode(around).alias("j")).withColumn("pos", F.col("j") * F.lit(float(n - 1)) / F.lit(k - 1))
    low, part = F.floor("pos"), F.col("pos") - F.floor("pos")
    high = F.least(low + 1, F.lit(n - 1))
    inside = [F.when((p >= F.col("before")) & (p < F.col("upto")), F.col("x")) for p in (low, high)]
    points = near.groupBy("j").agg(F.max(inside[0]).alias("a"), F.max(inside[1]).alias("b"), F.max(part).alias("part"))  # k rows
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return points.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("v")))), lambda e: e["v"]).alias("grid"))


def _count(grid: Column, x: Column, strictly: bool) -> Column:
    """How many points of a sorted array (up to 1,024) lie below ``x`` (``strictly``) or not above it, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(10, -1, -1)])

    def step(at: Column, s: Column) -> Column:
        there = F.get(grid, at + s - 1)
        return F.when(there < x if strictly else there <= x, at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def quantile_transform(df: DataFrame, column: str, out: str, grid: DataFrame, normal: bool = False) -> DataFrame:
    """``df`` with ``out``: the place of ``column`` on the grid between 0 and 1, of a value that takes several points the middle
    of them; with ``normal`` the normal quantile of that place. A null or NaN stays as it is."""
    bound = df.crossJoin(F.broadcast(grid.withColumnRenamed("grid", "__grid")))  # one row
    g, x = F.col("__grid"), F.col(column).cast("double")
    last = F.size(g) - 1
    bound = bound.withColumns({"__below": _count(g, x, True), "__upto": _count(g, x, False)})
    at = F.get(g, F.col("__upto") - 1)
    between = (F.col("__upto") - 1) + (x - at) / (F.get(g, F.col("__upto")) - at)
    place = F.when(F.col("__upto") > F.col("__below"), (F.col("__below") + F.col("__upto") - 1) / 2.0).otherwise(between) / F.greatest(last, F.lit(1))
    p = F.when(x - EDGE < F.get(g, F.lit(0)), 0.0).when(x + EDGE > F.get(g, last), 1.0).otherwise(place)
    if normal:
        edge = F.lit(EDGE - np.spacing(1.0))
        p = inverse_normal(F.greatest(edge, F.least(1 - edge, p)))
    return bound.withColumn(out, F.when(x.isNull() | F.isnan(x), x).otherwise(p)).drop("__grid", "__below", "__upto")


# Categorical plans.


def drawn(*key: object) -> int:
    """``draw`` for the driver: the same integer for the same key."""
    return int(hashlib.md5("".join(map(str, key)).encode()).hexdigest()[:8], 16)


def shuffled(items: list, seed: str) -> list:
    """A seeded order."""
    return sorted(items, key=lambda x: (drawn(seed, "|", x), str(x)))


@dataclass(frozen=True)
class Part:
    """A column of the plan: ``kind`` is kept, ordinal or onehot; ``cuts`` are row numbers of the drawn rows, ``classes`` the order of classes."""

    column: str
    kind: str
    classes: tuple[int, ...] = ()
    cuts: tuple[int, ...] = ()


def category_plan(columns: list[str], seed: str, share: float = 0.5, most: int = 10, onehot: float = 0.5) -> list[Part]:
    """Which columns become categories, of how many classes (2 to ``most``), ordinal or one-hot, and at which drawn rows'
    values they are cut. Nothing of it depends on the data. Columns that stay come first; one-hot classes are in a drawn order."""
    order = shuffled(columns, f"{seed}|pick")
    chosen = set(order[: round(share * len(columns))])
    plan = [Part(c, "kept") for c in columns if c not in chosen]
    for c in (c for c in columns if c in chosen):
        n = 2 + drawn(seed, "|n|", c) % (most - 1)
        hot = drawn(seed, "|hot|", c) / 2**32 < onehot
        classes = shuffled(list(range(n)), f"{seed}|class|{c}") if hot else list(range(n))
        cuts = shuffled(list(range(most - 1)), f"{seed}|cut|{c}")[: n - 1]
        plan.append(Part(c, "onehot" if hot else "ordinal", tuple(classes), tuple(cuts)))
    return plan


def categorised(df: DataFrame, key: str, plan: list[Part], seed: str, most: int = 10) -> DataFrame:
    """``key, f0, f1, ...``: the plan as one projection. A class is the number of cut values that a value exceeds, renamed by the plan's
    order; one-hot takes a column a class; the columns' order is drawn at the end. The cut rows, ``most`` - 1 with the least draws of
    their keys (fewer if the table has fewer), are all that the driver gets. A null has no class: null, or zeros."""
    names = [p.column for p in plan]
    rows = df.select(key, *names).orderBy(draw(f"{seed}|row|", F.col(key)), key).limit(most - 1).collect()
    out: list[Column] = []
    for p in plan:
        x = F.col(f"`{p.column}`").cast("double")
        if p.kind == "kept":
            out.append(x)
            continue
        cuts = [float(rows[k][p.column]) for k in p.cuts if k < len(rows) and rows[k][p.column] is not None]
        raw = sum(((x > c).cast("int") for c in cuts), F.lit(0))
        named = F.get(F.array(*[F.lit(c) for c in p.classes]), raw)
        out += [F.coalesce((named == c).cast("double"), F.lit(0.0)) for c in range(len(p.classes))] if p.kind == "onehot" else [named.cast("double")]
    order = shuffled(list(range(len(out))), f"{seed}|order")
    return df.select(key, *[out[k].alias(f"f{i}") for i, k in enumerate(order)])


# Smoothed singular vectors.


def smoothed(vectors: DataFrame, edges: DataFrame, key: str, column: str, steps: int) -> DataFrame:
    """``node, v``: vectors after so many normalised sums over neighbours and the node itself. Vectors of one length go along the
    edges whole, to each block of targets once; others element by element."""
    whole = written(vectors.select(F.col(key).cast("bigint").alias("node"), F.col(column).cast("array<double>").alias("v")).where("size(v) > 0"), "vectors")
    shape = whole.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.every(F.forall("v", lambda e: e.isNotNull())).alias("full")).first()
    if shape["full"] and shape["low"] == shape["high"]:
        looped = written(edges.select("src", "dst").unionByName(whole.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()), "looped")
        root = written(node_degrees(looped).select("node", F.sqrt("d").alias("s")), "roots")
        scaled = F.transform("v", lambda e: e / F.col("s"))
        for _ in range(steps):
            sums = gathered(written(whole.join(root, "node").select("node", scaled.alias("v")), "scaled"), looped, {"v": "sum"})
            whole = written(sums.join(root, "node").select("node", scaled.alias("v")), "smoothed")
        return whole
    x = vectors.select(F.col(key).alias("node"), F.posexplode(column).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    for _ in range(steps):
        x = written(aggregate_neighbours(x, edges, "gcn"), "smoothed")
    return x.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def _passed(rows: DataFrame, width: int, work) -> list[bytes]:
    """What ``work(block)`` gives for each task's rows, blocks of up to 4,096, as arrays that ``work`` may join: one a task."""

    def run(batches):
        total = None
        for batch in batches:
            block = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, width)
            for a in range(0, len(block), 4096):
                total = work(block[a : a + 4096], total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["part"])

    return [bytes(r[0]) for r in rows.mapInArrow(run, "part binary").collect()]  # a matrix a task


def truncated_svd(vectors: DataFrame, key: str, column: str, k: int, rounds: int = 6, more: int = 10, seed: str = "svd|") -> tuple[DataFrame, np.ndarray]:
    """``key, u`` (the rows times the ``k`` leading right singular vectors) and the singular values, by a randomised range finder.

    A drawn d x (k + ``more``) matrix is multiplied with the rows; each task takes the triangular factor of its blocks (tall and thin, one
    after the other), and the factors of all tasks are factored once more, so that the range is orthogonal without a row on the driver.
    ``rounds`` further passes sharpen it. The driver gets a matrix of the columns a task. Signs follow the largest entry of each vector.
    """
    rows = written(vectors.select(key, F.col(column).cast("array<double>").alias("__v")), "svd-rows")
    first = rows.select(F.size("__v").alias("d")).first()
    if first is None or not first[0]:
        return rows.select(key, F.array().cast("array<double>").alias("u")), np.zeros(0)
    d = first[0]
    k = min(k, d)
    wide = min(k + more, d)
    only = rows.select("__v")
    basis = np.linalg.qr(np.array([[drawn(seed, i, "|", j) / 2**32 - 0.5 for j in range(wide)] for i in range(d)]))[0]

    def triangular(right: np.ndarray) -> np.ndarray:
        def work(block, total):
            part = block @ right
            return np.linalg.qr(part if total is None else np.vstack([total, part]), mode="r")

        parts = [np.frombuffer(p).reshape(-1, right.shape[1]) for p in _passed(only, d, work)]
        return np.linalg.qr(np.vstack(parts), mode="r")

    def crossed(right: np.ndarray) -> np.ndarray:
        def work(block, total):
            part = block.T @ (block @ right)
            return part if total is None else total + part

        return sum(np.frombuffer(p).reshape(d, right.shape[1]) for p in _passed(only, d, work))

    for _ in range(rounds):
        r = triangular(basis)  # rows times basis = Q r; a column that vanishes keeps its direction
        basis = np.linalg.qr(crossed(basis @ np.linalg.pinv(r)))[0]
    _, values, turned = np.linalg.svd(triangular(basis))
    v = (basis @ turned.T)[:, :k]  # fewer where there are fewer rows
    k = v.shape[1]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    parts = [F.aggregate(F.zip_with("__v", F.array(*[F.lit(float(w)) for w in v[:, c]]), lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e) for c in range(k)]
    return rows.select(key, F.array(*parts).alias("u")), values[:k]

