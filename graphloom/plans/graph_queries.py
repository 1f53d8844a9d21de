"""Queries of the graph-table algebra: filters, set operations, joins, bundles, splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, draw_sql
from ..operators import graph as G
from ..operators import splits as S
from ..sources.fixtures import BIP, KG, LABEL, PART
from .registry import query

TRAIN_KG = "SELECT h, r, t FROM kg WHERE split = 'train'"


def _looped(t):
    """The part edges with a loop on every tenth part."""
    loops = t.part_nodes().where("node % 10 = 0").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return t.part_edges().unionByName(loops)


LOOPED = f"{PART}, looped AS (SELECT * FROM edges UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 10 = 0)"


@query("pf1_remove_self_loops", f"WITH {LOOPED} SELECT * FROM looped WHERE src <> dst")
def _(t):
    return G.remove_self_loops(_looped(t))


@query("pf2_forward_edges", f"WITH {KG} SELECT h AS src, r AS rel, t AS dst FROM kg")
def _(t):
    edges = t.triples().select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"), F.xxhash64("h", "r", "t").alias("edge_id"))
    both = edges.drop("edge_id").withColumn("inv", F.lit(False)).unionByName(G.reverse(edges.drop("edge_id")).withColumns({"rel": F.col("rel") + 6, "inv": F.lit(True)}))
    return both.where("NOT inv").drop("inv")


@query("pf3_combined_masks", f"WITH {KG} SELECT h, r, t FROM kg WHERE split IN ('train', 'test')")
def _(t):
    flagged = S.flags(t.triples())
    return flagged.where("visible OR is_test").select("h", "r", "t")


@query("pf4_split_resolution", f"WITH {KG} SELECT want, count(*) AS n FROM kg JOIN (VALUES ('train', 'train'), ('val', 'val'), ('test', 'test'), ('none', 'train')) AS w(want, split) USING (split) GROUP BY want")
def _(t):
    wanted = t.spark.createDataFrame([("train", "train"), ("val", "val"), ("test", "test"), ("none", None)], "want string, has string")
    resolved = S.resolve(wanted, "has")
    return t.triples().join(F.broadcast(resolved), "split").groupBy("want").agg(F.count("*").alias("n"))


@query("pf6_ignore_relations", f"WITH {KG} SELECT DISTINCT h, 0 AS r, t FROM kg")
def _(t):
    return t.triples().withColumn("r", F.lit(0)).select("h", "r", "t").distinct()


@query("pf10_top_classes", f"WITH {LABEL}, top AS (SELECT label FROM lab WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 3) SELECT node, CASE WHEN label IN (SELECT label FROM top) THEN label END AS label FROM lab")
def _(t):
    return S.restrict_classes(t.labels_of_parts(), 3)


@query("pf11_remap_classes", f"WITH {LABEL} SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS label FROM lab WHERE label IS NOT NULL AND label <> 2")
def _(t):
    return S.remap_classes(t.labels_of_parts().where("label IS NOT NULL AND label <> 2"))


@query("pf13_bipartite_range", f"WITH {BIP}, n AS (SELECT count(*) AS c FROM customer) SELECT node, node >= c AS is_tail FROM (SELECT src AS node FROM bip UNION SELECT dst FROM bip), n")
def _(t):
    nodes = t.purchases().select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("c")))).select("node", (F.col("node") >= F.col("c")).alias("is_tail"))


@query("pf16_one_relation", f"WITH {KG} SELECT least(h, t) AS src, greatest(h, t) AS dst FROM kg WHERE r = 2 UNION SELECT least(h, t), greatest(h, t) FROM kg WHERE r = 2")
def _(t):
    return G.undirected_pairs(t.triples().where("r = 2").select(F.col("h").alias("src"), F.col("t").alias("dst")))


@query("pf16_collapse_relations", f"WITH {KG} SELECT DISTINCT least(h, t) AS src, greatest(h, t) AS dst FROM kg WHERE h <> t")
def _(t):
    return G.undirected_pairs(t.triples().select(F.col("h").alias("src"), F.col("t").alias("dst")))


@query("pf17_labelled_nodes", f"WITH {LABEL} SELECT node, label IS NOT NULL AS labelled FROM lab")
def _(t):
    coded = t.labels_of_parts().select("node", F.coalesce("label", F.lit(-1)).cast("double").alias("y"))
    return S.clean_labels(coded, "y").select("node", F.col("y").isNotNull().alias("labelled"))


@query("so1_ordered_union", f"WITH {KG} SELECT h, r, t, min(o) AS ord FROM (SELECT h, r, t, 0 AS o FROM kg WHERE split <> 'test' UNION ALL SELECT h, r, t, 1 FROM kg WHERE split <> 'train') GROUP BY h, r, t")
def _(t):
    kg = t.triples()
    return G.ordered_union(kg.where("split <> 'test'"), kg.where("split <> 'train'"), keys=["h", "r", "t"])


@query("so2_augmented_union", f"WITH {KG} SELECT h, r, t FROM kg UNION SELECT t, r + 6, h FROM kg")
def _(t):
    return G.with_inverse_triples(t.triples(), 6)


@query("so4_symmetrise", f"WITH {LOOPED} SELECT src, dst FROM looped WHERE src <> dst UNION SELECT dst, src FROM looped WHERE src <> dst")
def _(t):
    return G.symmetrise(_looped(t), loops=False)


@query("so5_undirected_typed", f"WITH {KG} SELECT h AS src, r AS rel, t AS dst FROM kg UNION SELECT t, r, h FROM kg")
def _(t):
    return G.symmetrise(t.triples().select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst")))


@query("so6_directedness", f"WITH {KG}, {PART} SELECT 'kg' AS graph, (SELECT count(*) FROM (SELECT h, t FROM kg EXCEPT ALL SELECT t, h FROM kg)) > 0 AS directed UNION ALL SELECT 'parts', (SELECT count(*) FROM (SELECT src, dst FROM edges EXCEPT ALL SELECT dst, src FROM edges)) > 0")
def _(t):
    kg = t.triples().select(F.col("h").alias("src"), F.col("t").alias("dst"))
    found = [G.asymmetric(e).agg((F.count("*") > 0).alias("directed")).select(F.lit(n).alias("graph"), "directed") for n, e in (("kg", kg), ("parts", t.part_edges()))]
    return found[0].unionByName(found[1])


@query("so7_upper_triangle", f"WITH {LOOPED} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM looped WHERE src <> dst")
def _(t):
    return G.undirected_pairs(_looped(t))


@query("so8_split_classes", f"WITH {LABEL}, c AS (SELECT p_brand || ' ' || p_size AS class, part FROM part JOIN nsplit ON node = p_partkey) SELECT class FROM c WHERE part = 'test' EXCEPT SELECT class FROM c WHERE part = 'train'")
def _(t):
    """Classes (brand and size) of test nodes that no training node has."""
    classes = t.part.select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_brand", "p_size").alias("class"))
    met = classes.join(t.split_of_parts(), "node")
    return met.where("part = 'test'").select("class").distinct().join(met.where("part = 'train'").select("class").distinct(), "class", "left_anti")


@query("so9_disjoint_union", f"WITH {PART} SELECT src, dst FROM edges UNION ALL SELECT src + 1000000, dst + 1000000 FROM tedges")
def _(t):
    return G.disjoint_union(t.part_edges(), t.part_edges("train"), 1000000)


@query("so10_simple_graph", f"WITH {LOOPED}, dup AS (SELECT * FROM looped UNION ALL SELECT * FROM looped) SELECT src, dst FROM dup WHERE src <> dst UNION SELECT dst, src FROM dup WHERE src <> dst")
def _(t):
    edges = _looped(t)
    return G.symmetrise(edges.unionByName(edges), loops=False)


@query("so11_common_metrics", "SELECT event_type AS dataset FROM events WHERE user_id % 3 = 0 INTERSECT SELECT event_type FROM events WHERE user_id % 3 = 1 INTERSECT SELECT event_type FROM events WHERE user_id % 3 = 2")
def _(t):
    seeds = [t.runs().where(F.col("seed") == s).select("dataset") for s in range(3)]
    return seeds[0].intersect(seeds[1]).intersect(seeds[2])


@query("g1_inverse_edges", f"WITH {KG}, e AS (SELECT h * 1000000 + t * 10 + r AS edge_id, h, r, t FROM kg), n AS (SELECT max(edge_id) + 1 AS n FROM e) SELECT edge_id, h AS src, r AS rel, t AS dst, edge_id + n AS inv_edge_id, false AS is_inverse FROM e, n UNION ALL SELECT edge_id + n, t, r + 6, h, edge_id, true FROM e, n")
def _(t):
    edges = t.triples().select((F.col("h") * 1000000 + F.col("t") * 10 + F.col("r")).alias("edge_id"), F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"))
    return G.add_inverse(edges, 6)


@query("j15_inverse_map", f"WITH {PART} SELECT a.src * 1000000 + a.dst AS edge_id, a.dst * 1000000 + a.src AS inv_edge_id FROM edges a")
def _(t):
    edges = t.part_edges().select((F.col("src") * 1000000 + F.col("dst")).alias("edge_id"), "src", F.lit(0).alias("rel"), "dst")
    return G.inverse_map(edges)


BUNDLE = f"{KG}, ctx AS (SELECT h, r, t FROM kg WHERE split = 'train' OR h % 50 = 0)"


@query("g2_visible_and_queries", f"WITH {BUNDLE} SELECT kg.h, kg.r, kg.t, (split = 'train' OR h % 50 = 0) AS visible, split = 'test' AS is_query FROM kg WHERE split IN ('train', 'test') OR h % 50 = 0")
def _(t):
    kg = t.triples()
    return G.bundle(kg.where("split = 'train' OR h % 50 = 0"), query=kg.where("split = 'test'"))


@query("g3_transductive_bundle", f"WITH {KG} SELECT h, r, t, split = 'train' AS visible, split = 'train' AS is_train, split = 'val' AS is_val, split = 'test' AS is_test FROM kg")
def _(t):
    return S.flags(t.triples())


UND = f"{PART}, tr AS (SELECT DISTINCT u AS src, v AS dst FROM pairs WHERE split = 'train')"


@query("g4_undirected_bundle", f"WITH {UND} SELECT src, dst, 'train' AS split FROM tr UNION SELECT dst, src, 'train' FROM tr UNION SELECT u, v, split FROM pairs WHERE split <> 'train'")
def _(t):
    pairs = t.part_pairs()
    some = pairs.select(F.col("v").alias("src"), F.col("u").alias("dst"), "split")
    return G.undirected_bundle(some.unionByName(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit("test").alias("split")).where("split = 'none'")))


@query("g5_undirected_relations", f"WITH {KG}, tr AS (SELECT h, t, r FROM kg WHERE split = 'train') SELECT h AS src, t AS dst, r AS rel, 'train' AS split FROM tr UNION SELECT t, h, r, 'train' FROM tr UNION SELECT least(h, t), greatest(h, t), r, split FROM kg WHERE split <> 'train'")
def _(t):
    edges = t.triples().select(F.col("t").alias("src"), F.col("h").alias("dst"), F.col("r").alias("rel"), "split")
    return G.undirected_bundle(edges, ["rel"])


@query("g6_inductive_bundle", f"WITH {KG} SELECT 'train' AS graph, h, r, t, true AS visible, false AS is_query FROM kg WHERE split = 'train' AND h % 2 = 0 UNION ALL SELECT 'test', h, r, t, split = 'train', split = 'test' FROM kg WHERE h % 2 = 1 AND split <> 'val'")
def _(t):
    kg = t.triples()
    known, fresh = kg.where("h % 2 = 0"), kg.where("h % 2 = 1")
    seen = G.bundle(known.where("split = 'train'"), query=known.limit(0)).withColumn("graph", F.lit("train"))
    unseen = G.bundle(fresh.where("split = 'train'"), query=fresh.where("split = 'test'")).withColumn("graph", F.lit("test"))
    return seen.unionByName(unseen)


for _mode, _where in {
    "transductive": "true",
    "grail": "split IN ('train', 'test')",
    "ilpc": "true",
}.items():

    @query(f"g7_filter_set_{_mode}", f"WITH {KG} SELECT h, r, t FROM kg WHERE {_where}")
    def _(t, mode=_mode):
        return G.filter_set(S.flags(t.triples()), mode, "test")


@query("g8_train_filter", f"WITH {KG} SELECT h, r, t FROM kg WHERE split = 'train' UNION SELECT t, r + 6, h FROM kg WHERE split = 'train'")
def _(t):
    return G.with_inverse_triples(S.flags(t.triples()).where("visible"), 6)


@query("g9_positive_set", f"WITH {KG} SELECT h, r, t FROM kg WHERE split = 'train' UNION SELECT t, r + 6, h FROM kg WHERE split = 'train'")
def _(t):
    return G.positive_set(S.flags(t.triples()), "train_only", 6)


@query("ag1_filter_index", f"WITH {KG} SELECT h, r, string_agg(t::VARCHAR, ',' ORDER BY t) AS tails FROM (SELECT DISTINCT h, r, t FROM kg) GROUP BY h, r")
def _(t):
    return G.relation_lists(t.triples()).withColumn("tails", F.array_join("tails", ","))


@query("ag2_degrees", f"WITH {PART} SELECT p_partkey AS node, count(src) AS degree FROM part LEFT JOIN edges ON src = p_partkey GROUP BY p_partkey")
def _(t):
    return G.degrees(t.part_nodes(), t.part_edges())


@query("ag3_row_pointers", f"WITH {PART}, d AS (SELECT p_partkey AS node, count(src) AS degree FROM part LEFT JOIN edges ON src = p_partkey GROUP BY p_partkey) SELECT node, degree, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d")
def _(t):
    return G.row_pointers(t.part_nodes(), t.part_edges())


@query("ag4_class_splits", f"WITH {LABEL} SELECT coalesce(label, -1) AS label, count(*) AS n, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'val') AS n_val, count(*) FILTER (WHERE part = 'test') AS n_test FROM lab JOIN nsplit USING (node) GROUP BY 1")
def _(t):
    return S.class_splits(t.labels_of_parts(), t.split_of_parts())


@query("ag5_class_ranks", f"WITH {LABEL} SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM lab WHERE label IS NOT NULL GROUP BY label")
def _(t):
    return S.rank_classes(t.labels_of_parts())


@query("g10_stratified_split", f"WITH {LABEL}, o AS (SELECT node, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql("'10|' || node")}, node) AS k, count(*) OVER (PARTITION BY label) AS n FROM lab WHERE label IS NOT NULL) SELECT node, label, CASE WHEN k <= 20 THEN 'train' WHEN k <= 20 + (n - 20) // 2 THEN 'val' ELSE 'test' END AS part FROM o")
def _(t):
    return S.per_class_split(t.labels_of_parts().where("label IS NOT NULL"), 20, "10|")


@query("g11_edge_split", f"WITH {PART}, o AS (SELECT u, v, {draw_sql("'11|' || u || '|' || v")} / 4294967296.0::DOUBLE AS x FROM pairs) SELECT u AS src, v AS dst, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.8 THEN 'val' ELSE 'test' END AS split FROM o")
def _(t):
    return S.edge_split(t.part_pairs().select(F.col("u").alias("src"), F.col("v").alias("dst")), (0.7, 0.1), "11|")


@query("g12_random_masks", f"WITH o AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'12|' || p_partkey")}, p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT node, CASE WHEN k <= 100 THEN 'train' WHEN k <= 100 + round_even(0.2 * n, 0) THEN 'val' ELSE 'test' END AS part FROM o")
def _(t):
    return S.fixed_split(t.part_nodes(), 100, 0.2, "12|")


@query("g13_split_protocol", "SELECT dataset, unnest(range(n)) AS split_idx, n FROM (SELECT dataset, CASE WHEN k % 3 = 0 THEN 10 WHEN k % 3 = 1 THEN 5 ELSE 1 END AS n FROM (SELECT event_type AS dataset, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)))")
def _(t):
    names = t.events.select(F.col("event_type").alias("dataset")).distinct()
    numbered = names.withColumn("k", F.row_number().over(Window.orderBy("dataset")))  # one row a dataset
    counts = numbered.select("dataset", F.when(F.col("k") % 3 == 0, 10).when(F.col("k") % 3 == 1, 5).otherwise(1).alias("n"))
    return S.split_indices(counts)


@query("g15_positional_split", "SELECT p_partkey AS node, p_partkey < round_even(0.3 * (SELECT count(*) FROM part), 0) AS is_train FROM part")
def _(t):
    return S.positional_split(t.part_nodes(), 0.3)


@query(
    "g16_quantile_classes",
    "WITH s AS (SELECT list_sort(list(p_retailprice)) AS s, count(*) AS n, greatest(2, least(10, floor(sqrt(count(DISTINCT p_retailprice)))))::INT AS c FROM part), "
    "p AS (SELECT s, n, i / c::DOUBLE * (n - 1) AS x FROM s, unnest(range(1, c)) AS u(i)), "
    "q AS (SELECT list(s[floor(x)::INT + 1] + (x - floor(x)) * (s[least(floor(x)::INT + 2, n)] - s[floor(x)::INT + 1])) AS bounds FROM p) "
    "SELECT p_partkey AS node, len(list_filter(bounds, lambda x: x < p_retailprice)) AS label FROM part, q",
)
def _(t):
    return S.quantile_classes(t.part.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("y")))


@query("g17_permuted_ids", f"WITH {PART}, perm AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'17|' || p_partkey")}, p_partkey) - 1 AS new FROM part) SELECT a.new AS src, b.new AS dst FROM edges JOIN perm a ON src = a.node JOIN perm b ON dst = b.node")
def _(t):
    return S.permute_ids(t.part_nodes(), t.part_edges(), "17|")


@query("g18_inverse_queries", f"WITH {KG} SELECT h, r, t FROM kg WHERE split = 'test' UNION ALL SELECT t, (r + 6) % 12, h FROM kg WHERE split = 'test'")
def _(t):
    return G.query_directions(t.triples().where("split = 'test'"), 6)


@query("g18_direction_flags", f"WITH {KG} SELECT h, r, t, f AS predict_head FROM kg, (VALUES (false), (true)) AS x(f) WHERE split = 'test'")
def _(t):
    return G.query_directions(t.triples().where("split = 'test'"))


@query("g19_target_lists", f"WITH {PART} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS targets FROM tedges GROUP BY src")
def _(t):
    return G.neighbour_lists(t.part_edges("train")).withColumn("targets", F.array_join("targets", ","))


@query("j5_induced_subgraph", f"WITH {PART}, keep AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part WHERE p_size % 3 = 0) SELECT a.k AS src, b.k AS dst FROM edges JOIN keep a ON src = a.node JOIN keep b ON dst = b.node")
def _(t):
    return G.induced_subgraph(t.part_edges(), t.part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("node")))


@query("j7_batch_masking", f"WITH {KG}, b AS (SELECT h, r, t FROM kg WHERE split = 'train' AND h % 20 = 0), v AS (SELECT h, r, t FROM kg WHERE split = 'train' UNION ALL SELECT t, r + 6, h FROM kg WHERE split = 'train') SELECT h AS src, r AS rel, t AS dst FROM (SELECT h, r, t FROM v EXCEPT (SELECT h, r, t FROM b UNION SELECT t, (r + 6) % 12, h FROM b))")
def _(t):
    train = t.triples().where("split = 'train'").select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"))
    graph = train.unionByName(G.reverse(train).withColumn("rel", F.col("rel") + 6))
    return G.drop_edges(graph, train.where("src % 20 = 0"), 6)


@query("j7_batch_masking_undirected", f"WITH {PART} SELECT src, dst FROM tedges EXCEPT (SELECT u, v FROM pairs WHERE u % 9 = 0 UNION SELECT v, u FROM pairs WHERE u % 9 = 0)")
def _(t):
    return G.drop_edges(t.part_edges("train"), t.part_pairs().where("u % 9 = 0").select(F.col("u").alias("src"), F.col("v").alias("dst")))


@query("j10_feature_alignment", "SELECT count(*) AS entities, count(*) FILTER (WHERE vec_id IS NULL) AS missing FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def _(t):
    met = t.part.join(t.embeddings, F.col("p_partkey") == F.col("vec_id"), "left")
    return met.agg(F.count("*").alias("entities"), F.count_if(F.col("vec_id").isNull()).alias("missing"))


@query("j11_node_roles", f"WITH {KG}, q AS (SELECT h || '-' || r || '-' || t AS qid, h, r, t, h % 2 = 0 AS ph FROM kg WHERE split = 'test'), g AS (SELECT h, r, t FROM kg WHERE split = 'train'), x AS (SELECT qid, CASE WHEN ph THEN t ELSE h END AS node, 2 AS role FROM q UNION ALL SELECT qid, g.t, 1 FROM q JOIN g ON q.h = g.h AND q.r = g.r WHERE NOT ph UNION ALL SELECT qid, g.h, 1 FROM q JOIN g ON q.t = g.t AND q.r = g.r WHERE ph) SELECT qid, node, max(role) AS role FROM x GROUP BY qid, node")
def _(t):
    kg = t.triples()
    queries = kg.where("split = 'test'").select(F.concat_ws("-", "h", "r", "t").alias("qid"), "h", "r", "t", (F.col("h") % 2 == 0).alias("predict_head"))
    return G.node_roles(queries, kg.where("split = 'train'").select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst")))


@query("j14_cold_start", f"WITH {KG}, tr AS (SELECT DISTINCT r, t FROM kg WHERE split = 'train'), te AS (SELECT DISTINCT r, t FROM kg WHERE split = 'test'), ends AS (SELECT DISTINCT t FROM tr) SELECT (SELECT count(*) FROM te ANTI JOIN tr USING (r, t)) AS cold, (SELECT count(DISTINCT t) FROM te ANTI JOIN ends USING (t)) AS cold_tails, (SELECT count(*) FROM te) AS asked")
def _(t):
    """(relation, tail) pairs of test triples, those that no training triple has, and tails that none has."""
    kg = t.triples()
    test, train = (kg.where(f"split = '{s}'").select("r", "t").distinct() for s in ("test", "train"))
    cold = test.join(train, ["r", "t"], "left_anti").agg(F.count("*").alias("cold"))
    tails = test.join(train, "t", "left_anti").agg(F.countDistinct("t").alias("cold_tails"))
    return cold.crossJoin(tails).crossJoin(test.agg(F.count("*").alias("asked")))  # one row each


@query("j16_leakage", f"WITH {PART}, held AS (SELECT u AS src, v AS dst FROM pairs WHERE split <> 'train' OR u % 5 = 0) SELECT src, dst FROM held EXCEPT SELECT u, v FROM pairs WHERE split = 'train'")
def _(t):
    pairs = t.part_pairs()
    held = pairs.where("split <> 'train' OR u % 5 = 0").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return held.join(pairs.where("split = 'train'").select(F.col("u").alias("src"), F.col("v").alias("dst")), ["src", "dst"], "left_anti")


@query("j17_excluded_nodes", f"WITH {LABEL} SELECT node FROM nsplit WHERE part = 'train' EXCEPT SELECT p_partkey FROM part WHERE {draw_sql("'j17|' || p_partkey")} % 4 = 0")
def _(t):
    asked = t.part_nodes().where(draw("j17|", F.col("node")) % 4 == 0)
    return t.split_of_parts().where("part = 'train'").select("node").join(asked, "node", "left_anti")
