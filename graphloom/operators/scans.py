"""Prefix sums and dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a bucket; the table of buckets is that much smaller than the table of keys.
BUCKET = 1 << 16


def prefix_sum(df: DataFrame, key: str, value: str, out: str, *then: str) -> DataFrame:
    """Sum of ``value`` over all smaller integer keys (unique, or with the columns ``then``): within buckets of keys, then over bucket totals."""
    keyed = df.withColumn("__b", F.floor(F.col(key) / BUCKET))
    totals = keyed.groupBy("__b").agg(F.sum(value).alias("__t"))
    before = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__b").orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(before, "__b").withColumn(out, (F.col(out) + F.col("__base")).cast("bigint")).drop("__b", "__base")


def dense_ids(df: DataFrame, key: str, out: str, *then: str) -> DataFrame:
    """Numbers 0, 1, ... in order of an integer key, which is unique or goes on with the columns ``then``."""
    return prefix_sum(df.withColumn("__one", F.lit(1)), key, "__one", out, *then).drop("__one")


def numbered_within(df: DataFrame, group: str, key: str, out: str) -> DataFrame:
    """Numbers 0, 1, ... within each group in order of an integer key (unique in the group): within buckets of keys, then over the
    group's buckets, so that a group that holds most rows isn't one task's."""
    keyed = df.withColumn("__b", F.floor(F.col(key) / BUCKET))
    totals = keyed.groupBy(group, "__b").agg(F.count("*").alias("__t"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    own = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__b").orderBy(key)) - 1)
    return own.join(base, [group, "__b"]).withColumn(out, (F.col("__n") + F.col("__base")).cast("bigint")).drop("__b", "__n", "__base")


def prefix_max_within(df: DataFrame, group: str, key: str, value: str, out: str) -> DataFrame:
    """The greatest ``value`` of each group up to and with an integer key: within buckets of keys, then over the group's buckets."""
    keyed = df.withColumn("__b", F.floor(F.col(key) / BUCKET))
    tops = keyed.groupBy(group, "__b").agg(F.max(value).alias("__t"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select(group, "__b", F.max("__t").over(before).alias("__base"))
    upto = F.max(value).over(Window.partitionBy(group, "__b").orderBy(key).rangeBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn(out, upto).join(base, [group, "__b"]).withColumn(out, F.greatest(out, "__base")).drop("__b", "__base")


#: Ranges of values, of about as many rows each, in which values are summed up.
RANGES = 256


def value_prefix(df: DataFrame, column: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each value of a real column, with the sums over all rows of smaller or equal values: within
    ranges between quantiles, then over the totals of ranges. Values of one small interval share no single task."""
    from ..functions.scalars import bucketise

    bounds = df.agg(F.percentile_approx(column, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10000)).alias("__bounds"))  # one row
    per = df.groupBy(column).agg(*[v.alias(k) for k, v in sums.items()])
    cut = per.crossJoin(F.broadcast(bounds)).withColumn("__b", bucketise(F.col(column), F.col("__bounds"))).drop("__bounds")
    within = Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = cut.groupBy("__b").agg(*[F.sum(k).alias(k) for k in sums]).select("__b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    summed = cut.select(column, "__b", *[F.sum(k).over(within).alias(k) for k in sums])
    return summed.join(F.broadcast(totals), "__b").select(column, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])
