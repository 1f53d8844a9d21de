"""Roll-ups of metric rows ``dataset, seed, split_idx, metric, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over_seeds(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of each dataset and metric."""
    return runs.groupBy("dataset", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


def over_splits(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation over split means, for metrics that all splits of a dataset have."""
    per = runs.groupBy("dataset", "split_idx", "metric").agg(F.avg("value").alias("v"))
    n = runs.groupBy("dataset").agg(F.countDistinct("split_idx").alias("n"))
    out = per.groupBy("dataset", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.count("*").alias("k"))
    return out.join(n, "dataset").where("k = n").select("dataset", "metric", "mean", "std")


def macro(runs: DataFrame) -> DataFrame:
    """Mean over datasets of each plain metric; per-relation rows and the aggregate don't count."""
    plain = runs.where(~F.col("metric").rlike("^(mrr|hits@[0-9]+|num_queries)/") & (F.col("dataset") != "aggregate"))
    return plain.groupBy("dataset", "metric").agg(F.avg("value").alias("v")).groupBy("metric").agg(F.round(F.avg("v"), 6).alias("macro"), F.count("*").alias("datasets"))


def best_config(runs: DataFrame, config: str, by: str, value: str) -> DataFrame:
    """The configuration with the largest mean ``by`` of each dataset (the smaller of equals) and its mean ``value``."""
    per = runs.groupBy("dataset", config).agg(F.avg(by).alias("b"), F.avg(value).alias("v"))
    order = Window.partitionBy("dataset").orderBy(F.desc(F.round("b", 9)), config)
    return per.withColumn("k", F.row_number().over(order)).where("k = 1").select("dataset", config, F.round("b", 6).alias("best"), F.round("v", 6).alias("value"))


def merge_progress(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per run: the last epoch, the better best, either flag."""
    both = a.unionByName(b)
    return both.groupBy("run").agg(F.max("last_epoch").alias("last_epoch"), F.max("best").alias("best"), F.bool_or("done").alias("done"))


def pending(epochs: DataFrame, first: int, last: int) -> DataFrame:
    """Epochs of each run within [first, last], up to the first whose file isn't stable."""
    open_ = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return epochs.where(F.col("epoch").between(first, last)).withColumn("ok", F.min(F.col("stable").cast("int")).over(open_)).where("ok = 1").select("run", "epoch")


def consensus_mean(x: DataFrame) -> DataFrame:
    return x.groupBy("node").agg(F.round(F.avg("x"), 9).alias("x"))


def consensus_softmax(x: DataFrame) -> DataFrame:
    """Mean weighted by the softmax of ``logit`` within each node."""
    top = F.max("logit").over(Window.partitionBy("node"))
    w = x.withColumn("w", F.exp(F.col("logit") - top))
    return w.groupBy("node").agg(F.round(F.sum(F.col("w") * F.col("x")) / (F.sum("w") + 1e-8), 9).alias("x"))
