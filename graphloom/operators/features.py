"""Feature tables: node rows with vectors or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import value_prefix


def elements(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``key, i, x``: one row an element."""
    return vectors.select(key, F.posexplode(column).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def z_scores(x: DataFrame, fit: Column | None = None, clip: float | None = None) -> DataFrame:
    """Columns to mean 0 and population deviation 1 (at least 1e-12), from the rows that ``fit`` marks.

    Statistics are one row a column of the vector, joined back; rows aren't gathered.
    """
    own = F.col("x") if fit is None else F.when(fit, F.col("x"))
    stats = x.groupBy("i").agg(F.avg(own).alias("m"), F.greatest(F.stddev_pop(own), F.lit(1e-12)).alias("s"))
    z = (F.col("x") - F.col("m")) / F.col("s")
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return x.join(F.broadcast(stats), "i").withColumn("z", z)  # a row a column


def row_l2(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return F.transform(v, lambda e: e.cast("double") / F.greatest(norm, F.lit(1e-12)))


def row_l1(v: str, floor: float | None = None) -> Column:
    """Over the sum plus 0.01, or over at least ``floor``."""
    total = F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double"))
    return F.transform(v, lambda e: e.cast("double") / (total + 0.01 if floor is None else F.greatest(total, F.lit(floor))))


def drop_indices(v: str, gone: list[int]) -> Column:
    return F.filter(v, lambda e, i: ~i.isin(gone))


def constant_columns(x: DataFrame) -> DataFrame:
    """Columns of ``key, i, x`` with a single value."""
    return x.groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a = b").select("i")


def one_hot_columns(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, value, hot``: one row a present category; a binary column keeps its larger one."""
    values = df.groupBy(column).agg(F.lit(1).alias("one")).where(F.col(column).isNotNull())
    n = values.agg(F.count("*").alias("n"), F.min(column).alias("low"))
    kept = values.crossJoin(n).where(~((F.col("n") == 2) & (F.col(column) == F.col("low")))).select(F.col(column).alias("value"))  # the category domain
    return df.select(key, column).crossJoin(F.broadcast(kept)).select(key, "value", F.coalesce((F.col(column) == F.col("value")).cast("int"), F.lit(0)).alias("hot"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls become the most frequent value, the smaller of equals."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("__mode"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.coalesce(column, "__mode")).drop("__mode")  # one row


def clamp_outliers(df: DataFrame, column: str, width: float = 4.0) -> DataFrame:
    """Clamp at mean ± ``width`` deviations, the deviations estimated again without outliers."""
    first = df.agg(F.avg(column).alias("m1"), F.stddev_samp(column).alias("s1"))
    inside = F.when(F.abs(F.col(column) - F.col("m1")) <= width * F.col("s1"), F.col(column))
    second = df.crossJoin(F.broadcast(first)).agg(F.avg(inside).alias("m"), F.stddev_samp(inside).alias("s"))
    bound = df.crossJoin(F.broadcast(second))  # one row
    return bound.withColumn(column, F.greatest(F.col("m") - width * F.col("s"), F.least(F.col("m") + width * F.col("s"), F.col(column)))).drop("m", "s")


def binarise(df: DataFrame, column: str) -> DataFrame:
    """1 above the lower median."""
    median = df.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("__m"))
    return df.crossJoin(F.broadcast(median)).withColumn(column, (F.col(column) > F.col("__m")).cast("int")).drop("__m")  # one row


def quantile_scores(df: DataFrame, key: str, column: str) -> DataFrame:
    """Average rank over (n + 1): a uniform transform without a fitted grid; ties share a rank."""
    upto = value_prefix(df, column, {"upto": F.count("*")})
    own = df.groupBy(column).agg(F.count("*").alias("n")).join(upto, column)
    ranks = own.select(column, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("r"))
    size = df.agg(F.count("*").alias("size"))  # one row
    return df.join(ranks, column).crossJoin(F.broadcast(size)).select(key, (F.col("r") / (F.col("size") + 1)).alias("q"))


def intensity(df: DataFrame, column: str, want: float) -> DataFrame:
    """One row ``c``: the factor with sum(min(c p, 1)) = ``want`` over the positive values p. It is the largest of the
    factors that hold if the values above one of them are cut, so that one pass over sums by value finds it."""
    upto = value_prefix(df, column, {"n": F.count("*"), "s": F.sum(column)})
    size = df.agg(F.count("*").alias("size"))  # one row
    return upto.crossJoin(F.broadcast(size)).agg(F.max((want - (F.col("size") - F.col("n"))) / F.col("s")).alias("c"))


def principal_components(df: DataFrame, key: str, column: str, d: int) -> DataFrame:
    """``key, pc``: the ``d`` leading components (columns centred, signs fixed by the largest loading).

    The covariance is one aggregation of a fixed number of sums (columns squared); the
    driver decomposes that matrix, and rows are projected where they are.
    """
    import numpy as np

    x = elements(df, key, column)
    means = {r["i"]: r["m"] for r in x.groupBy("i").agg(F.avg("x").alias("m")).collect()}  # a row a column
    m = np.array([means[i] for i in sorted(means)])
    centre = F.array(*[F.lit(float(v)) for v in m])
    rows = df.select(key, F.zip_with(F.col(column), centre, lambda a, b: a.cast("double") - b).alias("v"))
    a = rows.select(key, "v", F.posexplode("v").alias("i", "a"))
    sums = a.select("i", F.posexplode(F.transform("v", lambda e: e * F.col("a"))).alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("s")).collect()  # columns squared
    cov = np.zeros((len(m), len(m)))
    for r in sums:
        cov[r["i"], r["j"]] = r["s"]
    _, vectors = np.linalg.eigh((cov + cov.T) / 2)
    top = vectors[:, ::-1][:, :d]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(d)])
    parts = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(w)) for w in top[:, k]]), lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e) for k in range(d)]
    return rows.select(key, F.array(*parts).alias("pc"))
