"""Synthetic graphs from ``range`` and seeded draws: every edge is a function of ids, so generation is a map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, hit, under, uniform
from .splits import permuted


def nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).toDF("node")


def path_graph(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """A path over a seeded permutation: places k and k + 1 are tied."""
    order = permuted(nodes(spark, n), seed)
    return order.select(F.col("node").alias("src"), "k").join(order.select(F.col("node").alias("dst"), (F.col("k") - 1).alias("k")), "k").select("src", "dst")


def recursive_tree(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """Every node but 0 hangs on a uniform earlier one."""
    return nodes(spark, n).where("node > 0").select(F.col("node").alias("src"), (draw(seed, F.col("node")) % F.col("node")).alias("dst"))


def random_pairs(spark: SparkSession, n: int, degree: int, seed: str) -> DataFrame:
    """n * degree directed draws of both ends."""
    return spark.range(n * degree).select((draw(seed, "a|", F.col("id")) % n).alias("src"), (draw(seed, "b|", F.col("id")) % n).alias("dst"))


#: Smaller ends of a row of pairs.
_RUN = 1 << 16


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """``src < dst, tail`` of all pairs, and the end of their keys: rows of ``dst`` and a run of smaller ids are dealt out, and
    unfolded where they are, so that no pair is numbered, joined or shuffled."""
    runs = nodes(spark, n).withColumnRenamed("node", "dst").where("dst > 0").select("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("dst") - 1) / _RUN))).alias("run"))
    dealt = runs.select("dst", "run", F.concat(F.lit("|"), F.col("dst").cast("string")).alias("tail")).repartition(8 * spark.sparkContext.defaultParallelism)
    last = F.least(F.col("dst"), (F.col("run") + 1) * _RUN) - 1
    return dealt.select("dst", "tail", F.explode(F.sequence(F.col("run") * _RUN, last)).alias("src"))


def bernoulli_pairs(spark: SparkSession, n: int, p: float, seed: str) -> DataFrame:
    """Each pair u < v with chance p."""
    return _pairs(spark, n).where(hit(under(p), seed, F.col("src"), F.col("tail"))).select("src", "dst")


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: str) -> DataFrame:
    """A ring with ties to the next k nodes, the far end rewired by chance p."""
    ring = nodes(spark, n).select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    there = (F.col("src") + F.col("j")) % n
    other = (F.col("src") + 1 + draw(seed, "to|", F.col("src"), "|", F.col("j")) % (n - 1)) % n
    return ring.select("src", F.when(uniform(seed, F.col("src"), "|", F.col("j")) < p, other).otherwise(there).alias("dst"))


def _by_class(classes: int, within: float, between: float) -> Column:
    """``under`` of the chance of a pair's blocks."""
    return F.when(F.col("src") % classes == F.col("dst") % classes, under(within)).otherwise(under(between))


def label_blocks(spark: SparkSession, n: int, classes: int, within: float, between: float, seed: str) -> DataFrame:
    """Pairs tied by chance ``within`` a class (id modulo classes) and ``between`` classes."""
    return _pairs(spark, n).where(hit(_by_class(classes, within, between), seed, F.col("src"), F.col("tail"))).select("src", "dst")


def grids(spark: SparkSession, count: int, side: int) -> DataFrame:
    """Disjoint square lattices: ``src, dst`` to the right and down; cell ids go on from grid to grid."""
    cell = spark.range(count * side * side).select(F.col("id").alias("src"), (F.floor(F.col("id") / side) % side).alias("row"), (F.col("id") % side).alias("col"))
    right = cell.where(F.col("col") < side - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = cell.where(F.col("row") < side - 1).select("src", (F.col("src") + side).alias("dst"))
    return right.unionByName(down)


def preferential(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """Every node ties to the end of a uniform earlier edge or to its start: preferential attachment by
    edge copying, resolved by pointer jumping over draws (no sequential loop)."""
    start = nodes(spark, n).where("node > 0").select(
        F.col("node").alias("src"), F.when(uniform(seed, "c|", F.col("node")) < 0.5, draw(seed, F.col("node")) % F.col("node")).alias("dst"),
        F.when(F.col("node") > 1, 1 + draw(seed, "e|", F.col("node")) % (F.col("node") - 1)).alias("copies"),
    ).withColumn("dst", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.col("dst")))
    live = start
    for _ in range(64):
        known = live.select(F.col("src").alias("c"), F.col("dst").alias("cd"), F.col("copies").alias("cc"))
        met = live.join(known, F.col("copies") == F.col("c"), "left")
        live = met.select("src", F.coalesce("dst", "cd").alias("dst"), F.when(F.col("dst").isNull() & F.col("cd").isNull(), F.col("cc")).alias("copies"))
        from .algorithms import settled

        live = settled(live)
        if live.where("dst IS NULL").isEmpty():
            break
    return live.select("src", "dst")


def sampled(spark: SparkSession, n: int, kind: str, seed: str) -> DataFrame:
    """``node, x`` by inverse transform of a uniform draw: uniform, normal, exponential or zipf."""
    u = uniform(seed, "u|", F.col("node"))
    v = uniform(seed, "v|", F.col("node"))
    forms = {
        "uniform": u,
        "normal": F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(2 * F.pi() * v),
        "exponential": -F.log(1 - u),
        "zipf": F.floor(F.pow(1 - u, F.lit(-1.0))),
    }
    return nodes(spark, n).select("node", forms[kind].alias("x"))


def planted_cycles(spark: SparkSession, motifs: int, length: int, first: int = 0) -> DataFrame:
    """``motifs`` disjoint cycles over consecutive ids, in one direction."""
    place = spark.range(motifs * length).select((F.col("id") + first).alias("src"), F.floor(F.col("id") / length).alias("m"), (F.col("id") % length).alias("j"))
    return place.select("src", (F.lit(first) + F.col("m") * length + (F.col("j") + 1) % length).alias("dst"))


#: Vectors of a block at most, and products that a task holds at once.
_VECTORS, _PRODUCTS = 1 << 15, 1 << 22


def kernel_graph(vectors: DataFrame, key: str, column: str, least: float, cells: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of vectors with cosine at least ``least``: all pairs by definition. Blocks of vectors meet two by two, and a
    task multiplies them as matrices; vectors with a null element are in no pair, nor are vectors of different lengths."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("x")).where(F.forall("x", lambda e: e.isNotNull()))
    blocks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _VECTORS))
    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.col("other")
    sent = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = sent.select("id", "x", (F.col("own") <= other).alias("left"), (F.least("own", other) * blocks + F.greatest("own", other)).alias("two"))

    def pairs(table: pa.Table) -> pa.Table:
        side, ids, x = (table.column(c).combine_chunks() for c in ("left", "id", "x"))
        side, ids, sizes = side.to_numpy(zero_copy_only=False), ids.to_numpy(), np.diff(x.offsets.to_numpy())
        alone = side.all()  # a block with itself
        flat, ends = x.flatten().to_numpy(), np.cumsum(sizes)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            v = flat[(ends[of] - size)[:, None] + np.arange(size)]
            norms, l = (v * v).sum(1), side[of]
            p, q = (np.arange(len(of)),) * 2 if alone else (np.flatnonzero(l), np.flatnonzero(~l))
            step = max(1, _PRODUCTS // max(1, len(q)))
            for a in range(0, len(p), step):
                part = p[a : a + step]
                with np.errstate(all="ignore"):
                    under = np.sqrt(norms[part][:, None] * norms[q])
                    k = (v[part] @ v[q].T) / under
                    i, j = np.nonzero(((k >= least - 1e-6) | np.isnan(k)) & (under != 0))
                first, second = ids[of[part[i]]], ids[of[q[j]]]
                once = first < second if alone else first != second
                found.append((np.minimum(first, second)[once], np.maximum(first, second)[once], k[i, j][once]))
        return pa.table({c: np.concatenate(part) for c, part in zip(("a", "b", "k"), zip(*found, strict=True), strict=True)})

    near = met.groupBy("two").applyInArrow(pairs, "a bigint, b bigint, k double")
    return near.select("a", "b", F.round("k", 6).alias("k")).where(F.col("k") >= least)


def ordered_ring(labels: DataFrame) -> DataFrame:
    """Nodes in order of (label, id) within each label, tied to the next."""
    own = Window.partitionBy("label").orderBy("node")
    return labels.select(F.col("node").alias("src"), F.lead("node").over(own).alias("dst")).where("dst IS NOT NULL")


def corrected_blocks(spark: SparkSession, n: int, classes: int, within: float, between: float, seed: str) -> DataFrame:
    """A block model whose nodes have weights in [0.5, 1.5): a pair's chance is its blocks' times both weights."""
    def weight(node):
        return uniform(seed, "w|", node) + 0.5

    p = F.when(F.col("src") % classes == F.col("dst") % classes, within).otherwise(between) * weight(F.col("src")) * weight(F.col("dst"))
    # most pairs fail at the greatest weights already, which takes one digest
    able = _pairs(spark, n).where(hit(_by_class(classes, 2.25 * within, 2.25 * between), f"{seed}e|", F.col("src"), F.col("tail")))
    return able.where(uniform(seed, "e|", F.col("src"), F.col("tail")) < p).select("src", "dst")


def motifs_for_rate(n: int, length: int, rate: float) -> int:
    """How many disjoint cycles of ``length`` give a share ``rate`` of ``n`` nodes on a cycle, at most what fits."""
    return max(0, min(n // length, round(rate * n / length)))
