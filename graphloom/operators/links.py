"""Link scores over shared neighbours, candidates and negatives."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw
from ..shared import written
from .meeting import overlaps
from .splits import permuted

ONE = 1.0


def node_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))


#: Edges that are broadcast, about 100 MB. A source's wedges are as many at most, so that one task holds them.
BROADCAST_EDGES = 4_000_000
#: Wedges that a task counts at once where edges are broadcast.
WEDGES = 1 << 21


def _weighed(edges: DataFrame) -> DataFrame:
    """``mid, cand, w``: an edge and one over the degree of where it starts."""
    d = node_degrees(edges).toDF("mid", "d")
    return edges.toDF("mid", "cand").join(d, "mid").select("mid", "cand", (ONE / F.col("d")).alias("w"))


def wedge_scores(edges: DataFrame, sources: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``src, cand, cn, ra``: every node two steps away, with its common neighbours and resource allocation.

    ``edges`` is simple and symmetric. With ``sources(src)`` only their wedges are made, and the pairs of
    ``known(src, dst)`` are left out. Up to BROADCAST_EDGES edges (they are written and counted) come to every task:
    sources are dealt once, and their wedges are made, counted and ranked where they are, without a shuffle. Beyond
    that, edges meet by their middle in a join that Spark may split, and pairs are summed up before they are shuffled.
    """
    edges = written(edges.select("src", "dst"), "wedge-edges")
    half = edges.join(sources.select("src").distinct(), "src", "left_semi") if sources is not None else edges
    middle, half = _weighed(edges), half.select("src", F.col("dst").alias("mid"))
    d = F.col("d").cast("double")
    size = node_degrees(edges).agg(F.sum("d").alias("edges"), F.sum(d * d).alias("wedges")).first()  # one row
    small = (size["edges"] or 0) <= BROADCAST_EDGES
    if small:  # so many parts that a task counts about WEDGES of them
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size["wedges"] or 0) / WEDGES))
        met = half.repartition(parts, "src").join(F.broadcast(middle), "mid")
    else:
        met = half.join(middle, "mid")
    pairs = met.where("src <> cand").groupBy("src", "cand").agg(F.count("w").alias("cn"), F.sum("w").alias("ra"))
    if known is None:
        return pairs
    known = known.select("src", F.col("dst").alias("cand"))
    if small and known.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        known = F.broadcast(known)
    return pairs.join(known, ["src", "cand"], "left_anti")


def pair_scores(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, cn, ra, pa`` of given pairs, zero where they share nothing. The neighbours of a pair's end of larger degree
    are sent to the other end's block, where its neighbours are looked up among them: no wedge is made.
    ``edges`` is simple and symmetric."""
    edges = written(edges.select("src", "dst"), "pair-edges")
    d = written(node_degrees(edges), "degrees")
    ends = written(pairs.select("src", "dst").distinct().join(d.toDF("src", "ds"), "src", "left").join(d.toDF("dst", "dd"), "dst", "left"), "pair-ends")
    from_src = F.col("ds") >= F.col("dd")
    turned = ends.where("ds > 0 AND dd > 0").select(F.when(from_src, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(from_src, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    weighed = edges.join(d.toDF("dst", "d"), "dst").select("src", "dst", (ONE / F.col("d")).alias("w"))
    found = written(overlaps(turned.distinct(), weighed), "pair-shared")
    # a pair may be asked for in both directions
    both = found.unionByName(found.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cn", "ra")).dropDuplicates(["src", "dst"])
    zero = F.lit(0)
    return ends.join(both, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("cn", zero).alias("cn"), F.coalesce("ra", zero.cast("double")).alias("ra"), (F.coalesce("ds", zero) * F.coalesce("dd", zero)).alias("pa")
    )


def ranked_candidates(scores: DataFrame, edges: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` best candidates of each source; ties go to the larger degree, then the smaller id."""
    d = written(node_degrees(edges).toDF("cand", "d"), "degrees")
    d = F.broadcast(d) if d.count() <= BROADCAST_EDGES else d
    order = Window.partitionBy("src").orderBy(F.desc(F.round(F.col(by), 9)), F.desc("d"), "cand")
    return scores.join(d, "cand").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "cand", "rank")


def balls(centres: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``node, x, d``: every node within ``hops`` of each centre, with its distance."""
    ball = centres.select("node", F.col("node").alias("x"), F.lit(0).alias("d"))
    for k in range(1, hops + 1):
        further = ball.where(F.col("d") == k - 1).join(edges, F.col("x") == F.col("src")).select("node", F.col("dst").alias("x"), F.lit(k).alias("d"))
        ball = ball.unionByName(further).groupBy("node", "x").agg(F.min("d").alias("d"))
    return ball


def shared_within_hops(pairs: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``src, dst, nij``: how many nodes lie within i hops of one end and within j of the other, for i, j up to ``hops``,
    counted exactly: an end's ball has a row a node with its distance, and balls meet by (pair, node)."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ball = balls(ends, edges, hops)
    a, b = ball.toDF("src", "x", "da"), ball.toDF("dst", "x", "db")
    met = pairs.join(a, "src").join(b, ["dst", "x"])
    counts = [F.count_if((F.col("da") <= i) & (F.col("db") <= j)).alias(f"n{i}{j}") for i in range(1, hops + 1) for j in range(1, hops + 1)]
    found = met.groupBy("src", "dst").agg(*counts)
    names = [f"n{i}{j}" for i in range(1, hops + 1) for j in range(1, hops + 1)]
    return pairs.join(found, ["src", "dst"], "left").select("src", "dst", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def negatives(positives: DataFrame, pool: DataFrame, k: int, seed: str) -> DataFrame:
    """``k`` tails of the pool for each (h, r), none of them a known positive, by draw order.

    A pair reads the permuted pool from a place of its own: as many places as it needs
    plus its positives, so the anti-join always leaves enough, without rejection rounds.
    """
    size = pool.agg(F.count("*").alias("m"))  # one row
    asked = positives.groupBy("h", "r").agg(F.count("*").alias("n")).crossJoin(F.broadcast(size))
    numbered = permuted(pool.select("node"), seed, "i").withColumnRenamed("node", "t")
    tries = asked.select("h", "r", "m", F.explode(F.sequence(F.lit(0), F.least(F.col("n") + k, F.col("m")) - 1)).alias("j"))
    first = draw(seed, F.col("h"), "|", F.col("r")) % F.col("m")
    drawn = tries.select("h", "r", "j", ((first + F.col("j")) % F.col("m")).alias("i")).join(numbered, "i").select("h", "r", "j", "t")
    free = drawn.join(positives.select("h", "r", "t"), ["h", "r", "t"], "left_anti")
    order = Window.partitionBy("h", "r").orderBy("j")
    return free.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("h", "r", "t", "nth")


def corrupted_tails(triples: DataFrame, n_nodes: int, offset: int, seed: str) -> DataFrame:
    """One tail for each triple by draw, any but its own (the draw skips it)."""
    x = draw(seed, F.col("h"), "|", F.col("r"), "|", F.col("t")) % (n_nodes - 1)
    return triples.select("h", "r", "t", (x + offset + (x + offset >= F.col("t")).cast("long")).alias("neg"))


def candidate_lists(train: DataFrame, test: DataFrame, nodes: DataFrame, k: int, seed: str) -> DataFrame:
    """``src, cand, is_pos``: each test source's targets and ``k`` non-neighbours by draw order."""
    taken = train.unionByName(test).select("src", "dst").distinct()
    sources = test.select("src").distinct()
    n = nodes.agg(F.count("*").alias("n"))  # one row
    known = taken.join(sources, "src", "left_semi").groupBy("src").agg(F.count("*").alias("d")).crossJoin(F.broadcast(n))
    tries = known.select("src", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("d") + k, F.col("n") - 1))).alias("j"))
    place = (draw(seed, F.col("src")) + F.col("j")) % F.col("n")
    numbered = permuted(nodes.select("node"), seed, "i").withColumnRenamed("node", "dst")
    free = tries.select("src", "j", place.alias("i")).join(numbered, "i").where("src <> dst").join(taken, ["src", "dst"], "left_anti")
    order = Window.partitionBy("src").orderBy("j")
    sampled = free.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("src", F.col("dst").alias("cand"), F.lit(False).alias("is_pos"))
    return test.select("src", F.col("dst").alias("cand"), F.lit(True).alias("is_pos")).distinct().unionByName(sampled)
