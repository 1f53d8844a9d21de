"""Ranks and metrics over score rows ``qid, cand, score``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ONE = 1.0


def true_ranks(scores: DataFrame, truth: DataFrame, known: DataFrame | None = None, ties: str = "pessimistic") -> DataFrame:
    """``qid, cand, rank`` of each query's true candidate. ``known(qid, cand)`` are left out, but for the truth.

    Scores are read once: a window over the query brings the true score beside every
    candidate, and the count reuses that shuffle. Counted are other scores at least as
    high (``pessimistic``; the truth counts itself) or above (``optimistic``).
    """
    real = truth.select("qid", F.col("cand").alias("true_cand"))
    met = scores.join(real, "qid")
    if known is not None:
        met = met.join(known.select("qid", "cand").distinct().withColumn("__known", F.lit(True)), ["qid", "cand"], "left")
    else:
        met = met.withColumn("__known", F.lit(None).cast("boolean"))
    is_true = F.col("cand") == F.col("true_cand")
    own = Window.partitionBy("qid", "true_cand")
    met = met.withColumn("true_score", F.max(F.when(is_true, F.col("score"))).over(own))
    beats = F.col("score") >= F.col("true_score") if ties == "pessimistic" else F.col("score") > F.col("true_score")
    counted = met.where("true_score IS NOT NULL").groupBy("qid", "true_cand").agg(F.count_if(~is_true & F.col("__known").isNull() & beats).alias("above"))
    return counted.select("qid", F.col("true_cand").alias("cand"), (F.col("above") + 1).alias("rank"))


def full_ranks(queries: DataFrame, candidates: DataFrame, score, most_rows: int = 1 << 20) -> DataFrame:
    """``queries`` (``truth`` and ``known``, an array of candidates to leave out, among their columns) with ``above`` and
    ``at``: how many other candidates score above the truth, and at least as high. ``score(cand)`` gives a column.
    Queries whose truth is no candidate have no rank.

    Every query meets every candidate by definition, but no score leaves its task: counts are
    summed there, and what is shuffled is a row for each query and task. Queries are spread first.
    """
    own = [k for k in queries.columns if k != "known"]
    wide = queries.sparkSession.sparkContext.defaultParallelism
    spread = queries.repartition(4 * wide).withColumn("__true", score(F.col("truth")))
    met = _product(spread, candidates.select("cand"), most_rows).withColumn("__s", score(F.col("cand"))).where(F.col("__s") >= F.col("__true"))
    other = F.col("cand") != F.col("truth")
    counted = met.where(~other | ~F.array_contains("known", F.col("cand")))
    return counted.groupBy(*own).agg(F.count_if(other & (F.col("__s") > F.col("__true"))).alias("above"), F.count_if(other).alias("at"))


def top_candidates(queries: DataFrame, candidates: DataFrame, score, k: int, known: str | None = None, block: int = 1024) -> DataFrame:
    """``queries`` with ``cand`` and ``rank`` of their ``k`` best candidates (ties to the smaller), but for those in the array ``known``.

    Candidates come in blocks; a task keeps ``k`` of each query and block, and only those are shuffled.
    """
    keys = [c for c in queries.columns if c != known]
    wide = queries.sparkSession.sparkContext.defaultParallelism
    blocks = candidates.select("cand").groupBy(F.floor(F.col("cand") / block).alias("__b")).agg(F.sort_array(F.collect_list("cand")).alias("__cands")).select("__cands")
    met = _product(queries.repartition(4 * wide), blocks, 1 << 10)
    fresh = F.array_except("__cands", F.col(known)) if known else F.col("__cands")
    scored = F.transform(fresh, lambda c: F.struct((-score(c)).alias("s"), c.alias("cand")))
    best = met.select(*keys, F.explode(F.slice(F.sort_array(scored), 1, k)).alias("x")).select(*keys, "x.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "cand"))).where(F.col("rank") <= k).drop("s")


def _product(left: DataFrame, right: DataFrame, most_rows: int) -> DataFrame:
    """All pairs: the right side broadcast where it has ``most_rows`` at most, else by blocks of both sides."""
    if right.limit(most_rows + 1).count() <= most_rows:
        return left.crossJoin(F.broadcast(right))
    return left.join(right.hint("shuffle_replicate_nl"))


def rank_metrics(ranks: DataFrame, by: str | None = None, hits: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """MRR, Hits@k and the number of queries; with ``by`` the total (null) and every value of it in one pass."""
    aggs = [F.round(F.avg(ONE / F.col("rank")), 9).alias("mrr"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 9).alias(f"hits_{k}") for k in hits], F.count("*").alias("n_queries")]
    return ranks.rollup(by).agg(*aggs) if by else ranks.agg(*aggs)


def recall_at_k(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """One row: sources, macro recall and NDCG, hits, pairs. ``ranked(src, cand, rank)``, ``targets(src, cand)``."""
    n = targets.groupBy("src").agg(F.count("*").alias("n"))
    hit = ranked.where(F.col("rank") <= k).join(targets, ["src", "cand"]).groupBy("src").agg(F.count("*").alias("h"), F.sum(ONE / F.log2(F.col("rank") + ONE)).alias("dcg"))
    top = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))
    ideal = F.aggregate(top, F.lit(0.0), lambda a, r: a + ONE / F.log2(r + ONE))
    per = n.join(hit, "src", "left").select("n", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), ideal.alias("ideal"))
    return per.agg(
        F.count("*").alias("sources"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"),
        F.sum("h").alias("hits"), F.sum("n").alias("pairs"), F.round(F.sum("dcg"), 6).alias("dcg"),
    )


def accuracy(class_scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of nodes whose best class (the smaller of equals) is their label."""
    best = class_scores.groupBy("node").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("best"))
    return best.join(labels, "node").agg(F.round(F.avg((F.col("best") == F.col("label")).cast("double")), 9).alias("accuracy"), F.count("*").alias("n"))


def one_vs_rest_auc(class_scores: DataFrame, labels: DataFrame) -> DataFrame:
    """AUC of every class by average ranks over all nodes; null where a class has no positives or no negatives."""
    met = class_scores.join(labels.withColumnRenamed("label", "truth"), "node").withColumn("pos", (F.col("label") == F.col("truth")).cast("int"))
    grouped = met.groupBy("label", "score").agg(F.sum("pos").alias("p"), F.count("*").alias("n"))  # ties share a row
    before = Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = grouped.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    tally = ranked.groupBy("label").agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    return tally.select("label", F.round(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * q), 9).alias("auc"))
