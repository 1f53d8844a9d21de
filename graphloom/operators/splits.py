"""Splits of nodes and edges, and class tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, uniform
from ..functions.scalars import bucketise
from .scans import dense_ids

#: Buckets of draws in which a permutation is numbered: sixty million a bucket for a trillion rows.
_BUCKETS = 1 << 14


def flags(triples: DataFrame) -> DataFrame:
    """``h, r, t, visible, is_train, is_val, is_test`` of rows with a ``split``: training edges are visible."""
    own = {f"is_{s}": F.bool_or(F.col("split") == s) for s in ("train", "val", "test")}
    return triples.groupBy("h", "r", "t").agg(F.bool_or(F.col("split") == "train").alias("visible"), *[v.alias(k) for k, v in own.items()])


def resolve(wanted: DataFrame, column: str) -> DataFrame:
    """A missing slot stands for train: the split to read in ``split``."""
    return wanted.withColumn("split", F.coalesce(column, F.lit("train"))).drop(column)


def clean_labels(nodes: DataFrame, label: str) -> DataFrame:
    """Missing codes (NaN, -1) as null."""
    return nodes.withColumn(label, F.nullif(F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double")), F.lit(-1.0)))


def rank_classes(labels: DataFrame) -> DataFrame:
    """``label, n, rank``: the largest class first, the smaller id of equals. One row a class, so one window serves."""
    counted = labels.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def restrict_classes(labels: DataFrame, k: int) -> DataFrame:
    """Labels outside the ``k`` largest classes become null; nodes stay."""
    top = rank_classes(labels).where(F.col("rank") <= k).select(F.col("label").alias("top"))  # k rows
    return labels.join(F.broadcast(top), F.col("label") == F.col("top"), "left").select("node", F.col("top").alias("label"))


def remap_classes(labels: DataFrame) -> DataFrame:
    """Present classes numbered 0, 1, ... in order of id."""
    present = labels.select("label").distinct().withColumn("new", F.row_number().over(Window.orderBy("label")) - 1)  # one row a class
    return labels.join(F.broadcast(present), "label").select("node", F.col("new").alias("label"))


def class_splits(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of each class (unlabelled as -1) by split."""
    met = labels.join(parts, "node").groupBy(F.coalesce("label", F.lit(-1)).alias("label"))
    return met.agg(F.count("*").alias("n"), *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "val", "test")])


def permuted(nodes: DataFrame, seed: str, out: str = "k") -> DataFrame:
    """``nodes`` with their place in a seeded permutation (by draw, then id), numbered by ranges of draws."""
    drawn = nodes.withColumn("__d", draw(seed, F.col("node")))
    bucketed = drawn.withColumn("__b", F.floor(F.col("__d") / (4294967296 // _BUCKETS)))
    totals = bucketed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = totals.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    numbered = bucketed.withColumn(out, F.row_number().over(Window.partitionBy("__b").orderBy("__d", "node")))
    return numbered.join(F.broadcast(before), "__b").withColumn(out, F.col(out) + F.col("__base") - 1).drop("__b", "__d", "__base")  # a row a bucket


def permute_ids(nodes: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    ids = permuted(nodes, seed).select("node", "k")
    return edges.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def per_class_split(labels: DataFrame, train: int, seed: str) -> DataFrame:
    """``train`` nodes of each class, half of the rest each for val and test."""
    own = Window.partitionBy("label")
    ranked = labels.select("node", "label", F.row_number().over(own.orderBy(draw(seed, F.col("node")), "node")).alias("k"), F.count("*").over(own).alias("n"))
    part = F.when(F.col("k") <= train, "train").when(F.col("k") <= train + F.floor((F.col("n") - train) / 2), "val").otherwise("test")
    return ranked.select("node", "label", part.alias("part"))


def edge_split(pairs: DataFrame, shares: tuple[float, float], seed: str) -> DataFrame:
    """Each pair's split by its own draw: no sort, no shuffle."""
    x = uniform(seed, F.col("src"), "|", F.col("dst"))
    return pairs.select("src", "dst", F.when(x < shares[0], "train").when(x < shares[0] + shares[1], "val").otherwise("test").alias("split"))


def fixed_split(nodes: DataFrame, train: int, val_share: float, seed: str) -> DataFrame:
    """Exactly ``train`` nodes, a rounded share for val, the rest for test."""
    total = nodes.agg(F.bround(F.count("*") * F.lit(val_share)).alias("v"))  # one row
    ranked = permuted(nodes, seed).crossJoin(F.broadcast(total))
    return ranked.select("node", F.when(F.col("k") < train, "train").when(F.col("k") < train + F.col("v"), "val").otherwise("test").alias("part"))


def positional_split(nodes: DataFrame, share: float) -> DataFrame:
    total = nodes.agg(F.bround(F.count("*") * F.lit(share)).alias("n"))  # one row
    return dense_ids(nodes, "node", "k").crossJoin(F.broadcast(total)).select("node", (F.col("k") < F.col("n")).alias("is_train"))


def split_indices(counts: DataFrame) -> DataFrame:
    """A row for each dataset and split index below its count ``n``."""
    return counts.select("dataset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("split_idx"), "n")


def quantile_classes(targets: DataFrame) -> DataFrame:
    """A real target in max(2, min(10, floor(sqrt(distinct)))) classes by its quantiles."""
    c = targets.agg(F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.sqrt(F.countDistinct("y"))))).cast("int").alias("c")).first()["c"]
    bounds = targets.agg(F.percentile("y", F.array(*[F.lit(i / c) for i in range(1, c)])).alias("bounds"))  # one row
    return targets.crossJoin(F.broadcast(bounds)).select("node", bucketise(F.col("y"), F.col("bounds")).alias("label"))
