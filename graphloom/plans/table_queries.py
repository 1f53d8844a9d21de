"""Queries of features, reports, sources, iterative algorithms, generators and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..functions.draws import draw, draw_sql
from ..operators import algorithms as A
from ..operators import features as FE
from ..operators import generate as GN
from ..operators import links as L
from ..operators import reports as RP
from ..operators import sketches as SK
from ..operators import splits as S
from ..operators.scans import dense_ids
from ..sources import sinks, texts
from ..sources.fixtures import KG, LABEL, PART, RUNS
from .registry import query

# Features.

PRICE = "SELECT p_partkey AS node, p_retailprice AS x FROM part"


def _prices(t):
    return t.part.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), "p_size", "p_brand", "p_type")


@query("fe1_z_scores", f"WITH {LABEL}, x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)), s AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-12) AS s FROM x WHERE vec_id % 2 = 0 GROUP BY i) SELECT vec_id, i, round(greatest(-2, least(2, (x - m) / s)), 6) AS z FROM x JOIN s USING (i)")
def _(t):
    x = FE.elements(t.embeddings, "vec_id", "embedding")
    return FE.z_scores(x, F.col("vec_id") % 2 == 0, 2.0).select("vec_id", "i", F.round("z", 6).alias("z"))


@query("fe2_row_norms", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: abs(e::DOUBLE))) / greatest(sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))), 1e-12), 6) AS l2_mass, round(embedding[1]::DOUBLE / (list_sum(list_transform(embedding, lambda e: e::DOUBLE)) + 0.01), 6) AS l1_first FROM embeddings")
def _(t):
    mass = F.aggregate(FE.row_l2("embedding"), F.lit(0.0), lambda a, e: a + F.abs(e))
    return t.embeddings.select("vec_id", F.round(mass, 6).alias("l2_mass"), F.round(FE.row_l1("embedding")[0], 6).alias("l1_first"))


@query("fe3_row_l1_floor", "SELECT vec_id, round(embedding[1]::DOUBLE / greatest(list_sum(list_transform(embedding, lambda e: e::DOUBLE)), 1), 6) AS first FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(FE.row_l1("embedding", 1.0)[0], 6).alias("first"))


@query("pf7_dropped_indices", "SELECT vec_id, len(embedding) - 2 AS n, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[3]::DOUBLE, 6) AS second FROM embeddings")
def _(t):
    kept = FE.drop_indices("embedding", [1, 5])
    return t.embeddings.select("vec_id", F.size(kept).alias("n"), F.round(kept[0].cast("double"), 6).alias("first"), F.round(kept[1].cast("double"), 6).alias("second"))


@query("pf8_constant_columns", "SELECT i FROM (SELECT 0 AS i, count(DISTINCT p_size) AS n FROM part UNION ALL SELECT 1, 1 UNION ALL SELECT 2, count(DISTINCT p_retailprice) FROM part) WHERE n = 1")
def _(t):
    rows = t.part.select("p_partkey", F.array(F.col("p_size").cast("double"), F.lit(1.0), F.col("p_retailprice")).alias("v"))
    return FE.constant_columns(FE.elements(rows, "p_partkey", "v"))


@query("pf9_distinct_counts", "SELECT count(DISTINCT p_size) AS sizes, count(DISTINCT CASE WHEN p_size < 0 THEN p_size END) AS none FROM part")
def _(t):
    return t.part.agg(F.countDistinct("p_size").alias("sizes"), F.countDistinct(F.when(F.col("p_size") < 0, F.col("p_size"))).alias("none"))


@query("fe6_one_hot", "SELECT p_partkey, value, (p_type = value)::INT AS hot FROM part, (SELECT DISTINCT p_type AS value FROM part)")
def _(t):
    return FE.one_hot_columns(t.part, "p_partkey", "p_type")


@query("fe6_one_hot_binary", "SELECT p_partkey, 'large' AS value, (p_size > 25)::INT AS hot FROM part")
def _(t):
    return FE.one_hot_columns(t.part.withColumn("s", F.when(F.col("p_size") > 25, "large").otherwise("a small")), "p_partkey", "s")


@query("fe8_mode_imputation", "WITH x AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS v FROM part), m AS (SELECT v AS mode FROM x WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) SELECT node, coalesce(v, mode) AS v FROM x, m")
def _(t):
    x = t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("v"))
    return FE.impute_mode(x, "v")


@query("fe11_sample_scaling", "WITH s AS (SELECT avg(l_extendedprice) AS m, greatest(stddev_samp(l_extendedprice), 1e-6) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(-100, least(100, (l_extendedprice - m) / s)), 6) AS z FROM lineitem, s")
def _(t):
    s = t.lineitem.agg(F.avg("l_extendedprice").alias("m"), F.greatest(F.stddev_samp("l_extendedprice"), F.lit(1e-6)).alias("s"))
    z = X.clip((F.col("l_extendedprice") - F.col("m")) / F.col("s"), -100.0, 100.0)
    return t.lineitem.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", F.round(z, 6).alias("z"))


@query("fe12_outlier_clamp", "WITH x AS (SELECT event_id, CASE WHEN event_id % 500 = 0 THEN value * 1000 ELSE value END AS v FROM events), a AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM x), b AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM x WHERE abs(v - (SELECT m FROM a)) <= 4 * (SELECT s FROM a)) SELECT event_id, round(greatest(m - 4 * s, least(m + 4 * s, v)), 6) AS v FROM x, b")
def _(t):
    x = t.events.select("event_id", F.when(F.col("event_id") % 500 == 0, F.col("value") * 1000).otherwise(F.col("value")).alias("v"))
    return FE.clamp_outliers(x, "v").select("event_id", F.round("v", 6).alias("v"))


@query("fe13_median_binarise", "SELECT p_partkey AS node, (p_retailprice > (SELECT quantile_disc(p_retailprice, 0.5) FROM part))::INT AS x FROM part")
def _(t):
    return FE.binarise(_prices(t).select("node", "x"), "x")


@query("fe7_quantile_transform", "WITH r AS (SELECT p_partkey AS node, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r, count(*) OVER () AS n FROM part) SELECT node, round(r / (n + 1), 9) AS q FROM r")
def _(t):
    return FE.quantile_scores(_prices(t).select("node", "x"), "node", "x").select("node", F.round("q", 9).alias("q"))


@query("fe4_principal_components")
def _(t):
    return FE.principal_components(t.embeddings, "vec_id", "embedding", 4).select("vec_id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query("fe16_degree_feature", f"WITH {PART} SELECT p_partkey AS node, round(ln(1 + count(src)), 9) AS x FROM part LEFT JOIN edges ON src = p_partkey GROUP BY p_partkey")
def _(t):
    d = L.node_degrees(t.part_edges())
    return t.part_nodes().join(d, "node", "left").select("node", F.round(F.log1p(F.coalesce("d", F.lit(0))), 9).alias("x"))


@query("fe19_class_count", f"WITH {LABEL} SELECT max(label) + 1 AS classes, count(*) FILTER (WHERE label IS NULL) AS unlabelled FROM lab")
def _(t):
    return t.labels_of_parts().agg((F.max("label") + 1).alias("classes"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


@query("fe21_permuted_columns", "SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b FROM embeddings")
def _(t):
    order = F.array(F.lit(3), F.lit(1))
    moved = F.transform(order, lambda i: F.element_at("embedding", i + 1))
    return t.embeddings.select("vec_id", F.round(moved[0].cast("double"), 6).alias("a"), F.round(moved[1].cast("double"), 6).alias("b"))


@query("fe14_binned_classes", "SELECT p_partkey AS node, (p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT AS label FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("node"), X.bucketise(F.col("p_size"), F.array(F.lit(10), F.lit(20), F.lit(40))).alias("label"))


# Scalar functions.


@query("f2_softmax_argmax", "WITH x AS (SELECT vec_id, list_transform(embedding[1:5], lambda e: e::DOUBLE) AS x FROM embeddings), e AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x) SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top, list_position(x, list_max(x)) - 1 AS best FROM e")
def _(t):
    x = F.transform(F.slice("embedding", 1, 5), lambda e: e.cast("double"))
    return t.embeddings.select("vec_id", x.alias("x")).select("vec_id", F.round(F.array_max(X.softmax(F.col("x"))), 9).alias("top"), X.argmax(F.col("x")).alias("best"))


@query("f3_activations", "SELECT vec_id, CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END AS sign, CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END AS heaviside, round(exp(-x * x), 9) AS rbf, round(sin(x), 9) AS sine, round(sqrt(abs(x)), 9) AS sqrt_abs, CASE WHEN abs(x) <= 1 THEN 1.0 ELSE 0.0 END AS unit_interval, round(x * x, 9) AS square, round(abs(x), 9) AS abs FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)")
def _(t):
    x = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return x.select("vec_id", *[F.round(f(F.col("x")), 9).alias(k) for k, f in X.ACTIVATIONS.items()])


@query("f11_distances", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 5) AS l2, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 5) AS l1, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", F.round(X.l2(x, y), 5).alias("l2"), F.round(X.manhattan(x, y), 5).alias("l1"), F.round(X.dot(x, y), 5).alias("dot"))


@query("f12_percentiles", "SELECT round(quantile_cont(value, 0.5), 9) AS median, quantile_disc(value, 0.5) AS lower, round(quantile_cont(value, 0.9), 9) AS p90 FROM events")
def _(t):
    return t.events.agg(F.round(F.percentile("value", F.lit(0.5)), 9).alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("lower"), F.round(F.percentile("value", F.lit(0.9)), 9).alias("p90"))


@query("f9_json_fields", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# Reports.


@query("ag9_over_seeds", f"WITH {RUNS} SELECT dataset, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM runs GROUP BY dataset, metric")
def _(t):
    return RP.over_seeds(t.runs())


@query("ag10_over_splits", f"WITH {RUNS}, p AS (SELECT dataset, split_idx, metric, avg(value) AS v FROM runs GROUP BY ALL), n AS (SELECT dataset, count(DISTINCT split_idx) AS n FROM runs GROUP BY dataset) SELECT p.dataset, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM p JOIN n USING (dataset) GROUP BY p.dataset, metric, n HAVING count(*) = n")
def _(t):
    return RP.over_splits(t.runs())


@query("ag8_macro_average", f"WITH {RUNS}, p AS (SELECT dataset, metric, avg(value) AS v FROM runs GROUP BY ALL) SELECT metric, round(avg(v), 6) AS macro, count(*) AS datasets FROM p GROUP BY metric")
def _(t):
    extra = t.runs().where("seed = 0").withColumn("metric", F.concat(F.lit("mrr/"), "metric"))
    return RP.macro(t.runs().unionByName(extra))


@query("ag20_best_config", f"WITH {RUNS}, p AS (SELECT dataset, seed * 10 + split_idx AS config, avg(value) AS b, avg(value * 2) AS v FROM runs GROUP BY 1, 2) SELECT dataset, config, round(b, 6) AS best, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(b, 9) DESC, config) AS k FROM p) WHERE k = 1")
def _(t):
    runs = t.runs().select("dataset", (F.col("seed") * 10 + F.col("split_idx")).alias("config"), "value", (F.col("value") * 2).alias("double"))
    return RP.best_config(runs, "config", "value", "double")


@query("ag12_means_without_nan", "SELECT event_type AS task, user_id % 4 AS complexity, round(avg(value), 6) AS mean FROM events WHERE event_id % 11 <> 0 GROUP BY ALL")
def _(t):
    x = t.events.select(F.col("event_type").alias("task"), (F.col("user_id") % 4).alias("complexity"), F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("v"))
    return x.groupBy("task", "complexity").agg(F.round(F.avg(F.nanvl("v", F.lit(None).cast("double"))), 6).alias("mean"))


@query("ag21_best_checkpoint", "SELECT user_id AS run, arg_max(event_id, (value, -event_id)) AS checkpoint FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("checkpoint"))


@query("ag22_validation_score", f"WITH {RUNS} SELECT dataset, round((coalesce(avg(value) FILTER (WHERE metric = 'mrr'), 0) + coalesce(avg(value) FILTER (WHERE metric = 'accuracy'), 0)) / count(DISTINCT metric), 6) AS score FROM runs GROUP BY dataset")
def _(t):
    wide = t.runs().groupBy("dataset").pivot("metric", ["mrr", "accuracy"]).agg(F.avg("value"))
    parts = F.filter(F.array("mrr", "accuracy"), lambda x: x.isNotNull() & ~F.isnan(x))
    return wide.select("dataset", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts), 6).alias("score"))


@query("ag23_merged_progress", "SELECT user_id AS run, max(event_id) AS last_epoch, max(value) AS best, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id")
def _(t):
    rows = t.events.groupBy("user_id", (F.col("event_id") % 2).alias("half")).agg(F.max("event_id").alias("last_epoch"), F.max("value").alias("best"), F.bool_or(F.col("event_type") == "purchase").alias("done"))
    rows = rows.withColumnRenamed("user_id", "run")
    return RP.merge_progress(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half"))


@query("pf15_pending_epochs", "WITH e AS (SELECT user_id AS run, event_id AS epoch, event_id % 17 <> 0 AS stable FROM events WHERE event_id BETWEEN 100 AND 5000) SELECT run, epoch FROM (SELECT *, min(stable::INT) OVER (PARTITION BY run ORDER BY epoch) AS ok FROM e) WHERE ok = 1")
def _(t):
    epochs = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), (F.col("event_id") % 17 != 0).alias("stable"))
    return RP.pending(epochs, 100, 5000)


@query("ag13_consensus_mean", "SELECT user_id AS node, round(avg(value), 9) AS x FROM events GROUP BY user_id")
def _(t):
    return RP.consensus_mean(t.events.select(F.col("user_id").alias("node"), F.col("value").alias("x")))


@query("ag14_consensus_softmax", "WITH w AS (SELECT user_id AS node, value AS x, exp(event_id % 7 - max(event_id % 7) OVER (PARTITION BY user_id)) AS w FROM events) SELECT node, round(sum(w * x) / (sum(w) + 1e-8), 9) AS x FROM w GROUP BY node")
def _(t):
    return RP.consensus_softmax(t.events.select(F.col("user_id").alias("node"), F.col("value").alias("x"), (F.col("event_id") % 7).alias("logit")))


@query("ag19_ensemble_mean", f"WITH {KG} SELECT h || ':' || r AS qid, round(avg({draw_sql("h || '|' || t || '|' || d")} / 4294967296.0::DOUBLE), 9) AS score FROM kg, (VALUES (0), (1), (2)) AS x(d) WHERE split = 'test' GROUP BY h, r")
def _(t):
    draws = t.triples().where("split = 'test'").withColumn("d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return draws.groupBy(F.concat_ws(":", "h", "r").alias("qid")).agg(F.round(F.avg(draw(F.col("h"), "|", F.col("t"), "|", F.col("d")) / 4294967296.0), 9).alias("score"))


# Windows, samples and batches.


@query("w8_subsample", f"SELECT node FROM (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'w8|' || p_partkey")}, p_partkey) AS k FROM part) WHERE k <= 50")
def _(t):
    return S.permuted(t.part_nodes(), "w8|").where("k < 50").select("node")


@query("w9_chunks", "SELECT p_partkey AS node, p_partkey // 64 AS chunk, (p_partkey // 64) % 4 AS rank FROM part")
def _(t):
    from ..operators.scans import dense_ids

    placed = dense_ids(t.part_nodes(), "node", "k")
    return placed.select("node", F.floor(F.col("k") / 64).alias("chunk"), (F.floor(F.col("k") / 64) % 4).alias("rank"))


@query("w11_balanced_batch", f"WITH {LABEL} SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql("'w11|' || node")}, node) AS k FROM lab WHERE label IS NOT NULL) WHERE k <= 8")
def _(t):
    order = Window.partitionBy("label").orderBy(draw("w11|", F.col("node")), "node")
    return t.labels_of_parts().where("label IS NOT NULL").withColumn("k", F.row_number().over(order)).where("k <= 8").select("node", "label")


@query("w13_deck", f"SELECT p_partkey AS node, deck, (row_number() OVER (PARTITION BY deck ORDER BY {draw_sql("deck || '|' || p_partkey")}, p_partkey) - 1) // 128 AS batch FROM part, (VALUES (0), (1)) AS x(deck)")
def _(t):
    decks = [S.permuted(t.part_nodes(), f"{d}|").select("node", F.lit(d).alias("deck"), F.floor(F.col("k") / 128).alias("batch")) for d in (0, 1)]
    return decks[0].unionByName(decks[1])


@query("w14_neighbour_cap", f"WITH {PART} SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {draw_sql("src || '|' || dst")}, dst) AS k FROM edges) WHERE k <= 3")
def _(t):
    order = Window.partitionBy("src").orderBy(draw(F.col("src"), "|", F.col("dst")), "dst")
    return t.part_edges().withColumn("k", F.row_number().over(order)).where("k <= 3").select("src", "dst")


@query("w12_stratified_starts", f"WITH k AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'w12|' || p_partkey")}, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part) SELECT j AS walk_id, node FROM k, unnest(range(0, 5000)) AS u(j) WHERE j % n = k")
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    order = S.permuted(t.part_nodes(), "w12|")
    return t.spark.range(5000).toDF("walk_id").crossJoin(F.broadcast(n)).select("walk_id", (F.col("walk_id") % F.col("n")).alias("k")).join(order, "k").select("walk_id", "node")


@query("l17_train_queries", f"WITH b AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0), n AS (SELECT greatest(least(floor(count(*) * 0.1)::BIGINT, 150), (SELECT count(*) FROM b)) AS n FROM part) SELECT node FROM (SELECT node, row_number() OVER (ORDER BY first, {draw_sql("'l17|' || node")}, node) AS k FROM (SELECT p_partkey AS node, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE 1 END AS first FROM part)), n WHERE k <= n")
def _(t):
    batch = t.part_nodes().where("node % 97 = 0")
    want = max(min(int(t.part.count() * 0.1), 150), batch.count())
    extra = S.permuted(t.part_nodes().where("node % 97 <> 0"), "l17|").where(F.col("k") < want - batch.count()).select("node")
    return batch.unionByName(extra)


# Iterative algorithms.

BFS = f"""WITH RECURSIVE {PART}, b(node, hop) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, hop + 1 FROM b JOIN edges ON src = node WHERE hop < 12)"""


@query("it1_bfs_hops", f"{BFS} SELECT node, min(hop) AS hop FROM b GROUP BY node")
def _(t):
    return A.hops(t.part_edges(), t.part_nodes().where("node = 0"))


def _queue_sql(seed: str, budget: int, levels: int = 8) -> str:
    """Common table expressions up to ``q(node, hop, place)``; so many levels are more than these graphs have."""
    out = f"q0 AS ({seed})"
    for k in range(1, levels + 1):
        out += f""",
q{k} AS (SELECT node, hop, place FROM q{k - 1} UNION ALL SELECT * FROM (SELECT dst, {k}, (SELECT count(*) FROM q{k - 1}) + row_number() OVER (ORDER BY min(place), dst) - 1 AS place
  FROM q{k - 1} JOIN edges ON src = node WHERE hop = {k - 1} AND dst NOT IN (SELECT node FROM q{k - 1}) GROUP BY dst) WHERE place < {budget})"""
    return out + f", q AS (SELECT * FROM q{levels})"


HUB = "SELECT src AS node, 0 AS hop, 0::BIGINT AS place FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1"


@query("it1_queue_order", f"WITH {PART}, {_queue_sql(HUB, 500)} SELECT node, hop, place, (SELECT count(*) FROM q) >= 500 AS hit_budget FROM q")
def _(t):
    edges = t.part_edges()
    hub = L.node_degrees(edges).orderBy(F.desc("d"), "node").limit(1)
    order = A.queue_order(edges, hub, 500)
    full = order.agg((F.count("*") >= 500).alias("hit_budget"))  # one row
    return order.crossJoin(F.broadcast(full))


SEED = f"SELECT node, 0 AS hop, 0::BIGINT AS place FROM lab JOIN nsplit USING (node) WHERE part = 'train' AND label = (SELECT label FROM lab WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) ORDER BY {draw_sql("'it2|' || node")}, node LIMIT 1"


@query("it2_bfs_subsample", f"WITH {PART}, {LABEL}, {_queue_sql(SEED, 200)}, keep AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM q), ball AS (SELECT a.k AS src, z.k AS dst, src AS src_node, dst AS dst_node, y.label AS src_label FROM edges JOIN keep a ON src = a.node JOIN keep z ON dst = z.node LEFT JOIN lab y ON y.node = src), present AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new FROM (SELECT DISTINCT label FROM lab JOIN keep USING (node) WHERE label IS NOT NULL)) SELECT src, dst, src_node, dst_node, new AS src_label FROM ball LEFT JOIN present ON src_label = label")
def _(t):
    edges, labels = t.part_edges(), t.labels_of_parts()
    top = S.rank_classes(labels).where("rank = 1").select("label")  # one row
    pool = labels.join(F.broadcast(top), "label").join(t.split_of_parts().where("part = 'train'"), "node")
    seed = pool.orderBy(draw("it2|", F.col("node")), "node").limit(1)
    keep = dense_ids(A.queue_order(edges, seed, 200).select("node"), "node", "k")
    mapped = S.remap_classes(labels.join(keep, "node").where("label IS NOT NULL"))
    met = edges.toDF("src_node", "dst_node").join(keep.toDF("src_node", "src"), "src_node").join(keep.toDF("dst_node", "dst"), "dst_node")
    return met.join(mapped.toDF("src_node", "src_label"), "src_node", "left").select("src", "dst", "src_node", "dst_node", "src_label")


@query("it6_components", f"WITH RECURSIVE {PART}, r(node, root) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT dst, root FROM r JOIN edges ON src = node WHERE root < dst) SELECT node, min(root) AS root FROM r GROUP BY node")
def _(t):
    return A.components(t.part_nodes(), t.part_edges())


@query("it6_largest_component", f"WITH RECURSIVE {PART}, r(node, root) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT dst, root FROM r JOIN edges ON src = node WHERE root < dst), c AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT node FROM c WHERE root = (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)")
def _(t):
    return A.largest_component(t.part_nodes(), t.part_edges())


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {PART}, d AS (SELECT src, count(*) AS d FROM edges GROUP BY src), n AS (SELECT count(*) AS n FROM part), r0 AS (SELECT p_partkey AS node, 1.0::DOUBLE / n AS rank FROM part, n)"
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT p_partkey AS node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM part CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / d) AS got FROM edges JOIN d USING (src) JOIN r{k} ON node = src GROUP BY dst) g ON dst = p_partkey)"
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("it7_pagerank", _pagerank_sql(5))
def _(t):
    return A.pagerank(t.part_nodes(), t.part_edges(), 0.85, 5).select("node", F.round("rank", 9).alias("rank"))


for _how, _agg in (("sum", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max")):

    @query(f"ag15_neighbour_{_how}", f"WITH {PART} SELECT p_partkey AS node, round(coalesce(y, 0), 6) AS x FROM part LEFT JOIN (SELECT dst, {_agg}(p_retailprice) AS y FROM edges JOIN part ON src = p_partkey GROUP BY dst) g ON dst = p_partkey")
    def _(t, how=_how):
        x = _prices(t).select("node", F.lit(0).alias("i"), "x")
        return A.aggregate_neighbours(x, t.part_edges(), how).select("node", F.round("x", 6).alias("x"))


GCN = "lp AS (SELECT src, dst FROM edges UNION ALL SELECT p_partkey, p_partkey FROM part), d AS (SELECT src AS node, count(*) AS d FROM lp GROUP BY src), nrm AS (SELECT src, dst, 1 / sqrt((a.d * b.d)::DOUBLE) AS w FROM lp JOIN d a ON src = a.node JOIN d b ON dst = b.node)"


@query("it10_propagation", f"WITH {PART}, {GCN}, x0 AS (SELECT p_partkey AS node, p_size::DOUBLE AS x FROM part), x1 AS (SELECT dst AS node, sum(w * x) AS x FROM nrm JOIN x0 ON node = src GROUP BY dst), x2 AS (SELECT dst AS node, sum(w * x) AS x FROM nrm JOIN x1 ON node = src GROUP BY dst) SELECT node, 0 AS k, round(x, 6) AS x FROM x0 UNION ALL SELECT node, 1, round(x, 6) FROM x1 UNION ALL SELECT node, 2, round(x, 6) FROM x2")
def _(t):
    x = t.part.select(F.col("p_partkey").alias("node"), F.lit(0).alias("i"), F.col("p_size").cast("double").alias("x"))
    return A.propagate(x, t.part_edges(), 2).select("node", "k", F.round("x", 6).alias("x"))


CELLS = "c AS (SELECT id, id // 625 AS grid, (id // 25) % 25 AS row, id % 25 AS col FROM (SELECT s_suppkey * 625 + j AS id FROM supplier, range(625) AS x(j)) AS r)"


@query("it12_grid_distances", f"WITH {CELLS}, l AS (SELECT * FROM c WHERE {draw_sql("'it12|' || id")} % 200 = 0) SELECT c.grid, c.row, c.col, min(abs(c.row - l.row) + abs(c.col - l.col)) AS hop FROM c JOIN l USING (grid) GROUP BY ALL")
def _(t):
    cells = t.spark.range(625 * t.supplier.count()).select("id", F.floor(F.col("id") / 625).alias("grid"), (F.floor(F.col("id") / 25) % 25).alias("row"), (F.col("id") % 25).alias("col"))
    return A.nearest_labelled(cells.drop("id"), cells.where(draw("it12|", F.col("id")) % 200 == 0))


# Generators.


@query("gn12_grids", "WITH c AS (SELECT id AS src, (id // 25) % 25 AS row, id % 25 AS col FROM (SELECT s_suppkey * 625 + j AS id FROM supplier, range(625) AS x(j)) AS r) SELECT src, src + 1 AS dst FROM c WHERE col < 24 UNION ALL SELECT src, src + 25 FROM c WHERE row < 24")
def _(t):
    return GN.grids(t.spark, t.supplier.count(), 25)


@query("gn1_path", f"WITH k AS (SELECT id AS node, row_number() OVER (ORDER BY {draw_sql("'gn1|' || id")}, id) AS k FROM (SELECT p_partkey AS id FROM part) AS r) SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON b.k = a.k + 1")
def _(t):
    return GN.path_graph(t.spark, t.part.count(), "gn1|")


@query("gn2_recursive_tree", f"SELECT id AS src, {draw_sql("'gn2|' || id")} % id AS dst FROM (SELECT p_partkey AS id FROM part) AS r WHERE id > 0")
def _(t):
    return GN.recursive_tree(t.spark, t.part.count(), "gn2|")


@query("gn3_random_pairs", f"SELECT {draw_sql("'gn3|a|' || id")} % n AS src, {draw_sql("'gn3|b|' || id")} % n AS dst FROM (SELECT p_partkey * 4 + j AS id, (SELECT count(*) FROM part) AS n FROM part, range(4) AS x(j))")
def _(t):
    return GN.random_pairs(t.spark, t.part.count(), 4, "gn3|")


@query("gn3_bernoulli", f"SELECT a.id AS src, b.id AS dst FROM (SELECT p_partkey AS id FROM part) AS a, (SELECT p_partkey AS id FROM part) AS b WHERE a.id < b.id AND {draw_sql("'gn3b|' || a.id || '|' || b.id")} / 4294967296.0::DOUBLE < 0.05")
def _(t):
    return GN.bernoulli_pairs(t.spark, t.part.count(), 0.05, "gn3b|")


@query("gn4_small_world", f"SELECT id AS src, CASE WHEN {draw_sql("'gn4|' || id || '|' || j")} / 4294967296.0::DOUBLE < 0.1 THEN (id + 1 + {draw_sql("'gn4|to|' || id || '|' || j")} % (n - 1)) % n ELSE (id + j) % n END AS dst FROM (SELECT p_partkey AS id, (SELECT count(*) FROM part) AS n FROM part) AS r, (VALUES (1), (2), (3)) AS x(j)")
def _(t):
    return GN.small_world(t.spark, t.part.count(), 3, 0.1, "gn4|")


@query("gn9_label_blocks", f"SELECT a.id AS src, b.id AS dst FROM (SELECT p_partkey AS id FROM part) AS a, (SELECT p_partkey AS id FROM part) AS b WHERE a.id < b.id AND {draw_sql("'gn9|' || a.id || '|' || b.id")} / 4294967296.0::DOUBLE < CASE WHEN a.id % 3 = b.id % 3 THEN 0.2 ELSE 0.02 END")
def _(t):
    return GN.label_blocks(t.spark, t.part.count(), 3, 0.2, 0.02, "gn9|")


@query("gn13_planted_cycles", "SELECT 5 * m + j AS src, 5 * m + (j + 1) % 5 AS dst FROM (SELECT p_partkey AS m FROM part) AS a, range(5) AS b(j)")
def _(t):
    return GN.planted_cycles(t.spark, t.part.count(), 5)


@query("gn15_exponential", f"SELECT id AS node, round(-ln(1 - {draw_sql("'gn15|u|' || id")} / 4294967296.0::DOUBLE), 9) AS x FROM (SELECT p_partkey AS id FROM part) AS r")
def _(t):
    return GN.sampled(t.spark, t.part.count(), "exponential", "gn15|").select("node", F.round("x", 9).alias("x"))


@query("gn10_j12_kernel_graph", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * a.embedding[i]::DOUBLE)) * list_sum(list_transform(range(1, 65), lambda i: b.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))), 6) AS k FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE k >= 0.5")
def _(t):
    return GN.kernel_graph(t.embeddings, "vec_id", "embedding", 0.5)


GN6 = f"""WITH RECURSIVE s AS (SELECT n AS src, CASE WHEN n = 1 THEN 0 WHEN {draw_sql("'gn6|c|' || n")} / 4294967296.0::DOUBLE < 0.5 THEN {draw_sql("'gn6|' || n")} % n END AS dst,
  CASE WHEN n > 1 THEN 1 + {draw_sql("'gn6|e|' || n")} % (n - 1) END AS copies FROM (SELECT p_partkey AS n FROM part WHERE p_partkey > 0) AS a),
r AS (SELECT * FROM s UNION ALL SELECT r.src, s.dst, s.copies FROM r JOIN s ON s.src = r.copies WHERE r.dst IS NULL) SELECT src, dst FROM r WHERE dst IS NOT NULL"""


@query("gn6_preferential", GN6)
def _(t):
    return GN.preferential(t.spark, t.part.count(), "gn6|")


# Sketches.


SKETCHES = f"""WITH {PART}, lp AS (SELECT src, dst FROM tedges UNION SELECT p_partkey, p_partkey FROM part),
least AS (SELECT dst AS node, k, min(v) AS v FROM lp JOIN (SELECT p_partkey AS node, k, {draw_sql("'mh' || k || '|' || p_partkey")} AS v FROM part, range(128) AS a(k)) m ON m.node = src GROUP BY 1, 2),
one AS (SELECT p_partkey AS node, {draw_sql("'hll|' || p_partkey")} AS d FROM part), most AS (SELECT dst AS node, d % 256 AS k, max(24 - floor(log2(greatest(d // 256, 1)))) AS r FROM lp JOIN one ON one.node = src GROUP BY 1, 2),
q AS (SELECT u, v FROM pairs WHERE split = 'test'), j AS (SELECT q.u, q.v, count(*) FILTER (WHERE a.v = b.v) / 128.0::DOUBLE AS jaccard FROM q JOIN least a ON a.node = q.u JOIN least b ON b.node = q.v AND b.k = a.k GROUP BY q.u, q.v),
un AS (SELECT u, v, k, max(r) AS r FROM (SELECT u, v, k, r FROM q JOIN most ON node = u UNION ALL SELECT u, v, k, r FROM q JOIN most ON node = v) GROUP BY u, v, k),
c AS (SELECT u, v, 256 - count(*) AS empty, 0.7213 / (1 + 1.079 / 256.0::DOUBLE) * 65536 / (sum(power(2.0, -r)) + 256 - count(*)) AS raw FROM un GROUP BY u, v)
SELECT u AS src, v AS dst, round(jaccard, 6) AS jaccard, round(jaccard * CASE WHEN raw <= 640 AND empty > 0 THEN 256 * ln(256.0::DOUBLE / empty) ELSE raw END, 6) AS shared FROM j JOIN c USING (u, v)"""


@query("l7_l10_sketches", SKETCHES)
def _(t):
    edges = t.part_edges("train")
    one = SK.propagate(SK.initial(t.part_nodes()), edges)
    pairs = t.part_pairs().where("split = 'test'").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return SK.intersections(pairs, one).select("src", "dst", F.round("jaccard", 6).alias("jaccard"), F.round("shared", 6).alias("shared"))


# Sources and sinks.


def _lines(t, split):
    return t.triples().where(F.col("split") == split).select(F.lit(["train", "val", "test"].index(split)).alias("file"), (F.col("h") * 100000 + F.col("t") * 10 + F.col("r")).alias("line_no"), F.concat_ws("\t", F.concat(F.lit("e"), "h"), F.concat(F.lit("r"), "r"), F.concat(F.lit("e"), "t")).alias("value"))


TOKENS = f"{KG}, ln AS (SELECT CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS f, h * 100000 + t * 10 + r AS k, 'e' || h AS h, 'r' || r AS r, 'e' || t AS t FROM kg), tok AS (SELECT h AS token, f, k, 0 AS side FROM ln UNION ALL SELECT t, f, k, 1 FROM ln), voc AS (SELECT token, row_number() OVER (ORDER BY min((f, k, side))) - 1 AS id FROM tok GROUP BY token)"


@query("src1_src2_vocabulary", f"WITH {TOKENS} SELECT token, id FROM voc")
def _(t):
    found = texts.triples(_lines(t, "train").unionByName(_lines(t, "val")).unionByName(_lines(t, "test")))
    return texts.vocabulary(found)


@query("src3_encoded_triples", f"WITH {TOKENS}, rel AS (SELECT r AS token, row_number() OVER (ORDER BY min((f, k))) - 1 AS id FROM ln GROUP BY r) SELECT f AS file, a.id AS h, rel.id AS r, b.id AS t FROM ln JOIN voc a ON a.token = ln.h JOIN voc b ON b.token = ln.t JOIN rel ON rel.token = ln.r")
def _(t):
    found = texts.triples(_lines(t, "train").unionByName(_lines(t, "val")).unionByName(_lines(t, "test")))
    return texts.encoded(found, texts.vocabulary(found), texts.vocabulary(found, "relation"))


@query("src7_src8_matrix", "SELECT DISTINCT l_suppkey AS h, 0 AS r, l_linenumber + 1000 AS t FROM lineitem WHERE l_linenumber - 3 <> 0")
def _(t):
    matrix = t.lineitem.select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_linenumber") - 3).alias("val"))
    return texts.coo(matrix, 1000)


@query("src15_entity_texts", "SELECT p_partkey::VARCHAR AS offset, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ': ' || p_type END AS text FROM part")
def _(t):
    value = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(" "), "p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(", "), "p_type")))
    return texts.entity_texts(t.part.select(value.alias("value")))


@query("src16_log_metrics", "WITH l AS (SELECT event_type AS dataset, max(event_id) AS e FROM events GROUP BY event_type) SELECT dataset, 'mrr' AS metric, round(value, 3) AS value FROM l JOIN events ON event_id = e UNION ALL SELECT dataset, 'epoch', event_id::DOUBLE FROM l JOIN events ON event_id = e")
def _(t):
    line = F.concat(F.lit("x [eval_only] "), "event_type", F.lit(" done: mrr="), F.format_string("%.3f", F.round("value", 3)), F.lit(", epoch="), "event_id")
    return texts.log_metrics(t.events.select(F.lit(0).alias("file"), F.col("event_id").alias("line_no"), line.alias("value")))


@query("src17_json_metrics", "SELECT event_id, event_type AS dataset, 'mrr' AS metric, round(value, 3) AS value FROM events UNION ALL SELECT event_id, event_type, 'acc', 0.5 FROM events UNION ALL SELECT event_id, event_type, 'acc_std', 0.25 FROM events")
def _(t):
    payload = F.format_string('{"metrics": {"%s": {"mrr": %.3f, "acc": {"mean": 0.5, "std": 0.25}}}}', "event_type", F.round("value", 3))
    return t.events.select("event_id", F.explode(texts.json_metrics(payload)).alias("m")).select("event_id", "m.*")


@query("snk4_fixed_columns", "SELECT event_id::VARCHAR AS event_id, '' AS missing, event_type FROM events")
def _(t):
    return sinks.fixed_columns(t.events.select("event_id", "event_type"), ["event_id", "missing", "event_type"])


@query("snk7_text_table", "SELECT rtrim(rpad(p_partkey::VARCHAR, 8, ' ') || ' ' || rpad(CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '-' END, 6, ' ')) AS line FROM part")
def _(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return sinks.text_table(rows, {"p_partkey": 8, "size": 6})


@query("x7_grid_expansion", "SELECT a || '-' || n AS config FROM (SELECT DISTINCT event_type AS a FROM events), (SELECT DISTINCT p_size AS n FROM part)")
def _(t):
    """Every event type with every part size, two domains, as a grid of settings."""
    sizes = t.part.select("p_size").distinct().agg(F.collect_list("p_size").alias("ns"))  # a domain in one row
    return t.events.select(F.col("event_type").alias("a")).distinct().crossJoin(F.broadcast(sizes)).select("a", F.explode("ns").alias("n")).select(F.concat_ws("-", "a", "n").alias("config"))
