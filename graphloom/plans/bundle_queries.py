"""Queries of folder readers, bundle views, catalogs and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import samplers as SA
from ..functions.draws import draw, draw_sql
from ..operators import links as L
from ..operators import splits as S
from ..operators import walks as WK
from ..operators.scans import dense_ids
from ..shared import fresh_path, written
from ..sources import array_source as arrays
from ..sources import bundles as B
from ..sources.fixtures import KG, LABEL, PART
from .registry import query

# Knowledge graphs of several files: the triples go out as text and come back as numbers. Entities are
# compared by their degree, since numbers follow the order of first sight.


def _folder(t, files: dict[str, str]) -> str:
    """A folder of triple files, each a filter of the triples, 'e<h> r<r> e<t>' a line."""
    folder = fresh_path(t.spark, "kg")
    rows = t.triples().withColumn("value", F.concat(F.lit("e"), "h", F.lit("\tr"), "r", F.lit("\te"), "t"))
    for file, where in files.items():
        rows.where(where).select("value").write.text(f"{folder}/{file}")
    return folder


def _profile(found, *by):
    """Triples, entities, relations and the largest entity number of each part."""
    both = found.select(*by, "r", F.explode(F.array("h", "t")).alias("e"))
    return both.groupBy(*by).agg((F.count("*") / 2).cast("bigint").alias("triples"), F.countDistinct("e").alias("entities"), F.countDistinct("r").alias("relations"))


def _scopes_sql(cases: list[tuple[str, str, str]]) -> str:
    """Rows (scope, part, filter) profiled one by one."""
    one = "SELECT '{s}' AS scope, '{p}' AS part, count(*) AS triples, (SELECT count(*) FROM (SELECT h FROM kg WHERE {w} UNION SELECT t FROM kg WHERE {w})) AS entities, count(DISTINCT r) AS relations FROM kg WHERE {w}"
    return f"WITH {KG} " + " UNION ALL ".join(one.format(s=s, p=p, w=w) for s, p, w in cases)


EVEN, ODD = "h % 2 = 0", "h % 2 = 1"


@query("src3_three_files", f"WITH {KG} SELECT split AS part, count(*) AS triples, (SELECT count(*) FROM (SELECT h FROM kg b WHERE b.split = kg.split UNION SELECT t FROM kg b WHERE b.split = kg.split)) AS entities, count(DISTINCT r) AS relations FROM kg GROUP BY split")
def _(t):
    folder = _folder(t, {"train.txt": "split = 'train' AND r < 5", "facts.txt": "split = 'train' AND r = 5", "valid.txt": "split = 'val'", "test.txt": "split = 'test'"})
    found = B.transductive(t.spark, folder, facts=True)
    return _profile(found.withColumn("part", F.when(F.col("part") == "valid", "val").otherwise(F.col("part"))), "part")


@query("src4_inductive_files", _scopes_sql([("train", "graph", f"split = 'train' AND {EVEN}"), ("inference", "graph", f"split = 'train' AND {ODD}"), ("inference", "valid", f"split = 'val' AND {ODD}"), ("inference", "test", f"split = 'test' AND {ODD}")]))
def _(t):
    folder = _folder(t, {"train_graph.txt": f"split = 'train' AND {EVEN}", "inference_graph.txt": f"split = 'train' AND {ODD}", "validation.txt": f"split = 'val' AND {ODD}", "test.txt": f"split = 'test' AND {ODD}"})
    return _profile(B.inductive(t.spark, folder, valid_on_inference=True), "scope", "part")


@query("src5_five_files", _scopes_sql([("train", "graph", f"split = 'train' AND {EVEN}"), ("train", "valid", f"split = 'val' AND {EVEN}"), ("inference", "graph", f"split = 'train' AND {ODD}"), ("inference", "test", f"split <> 'train' AND {ODD}")]))
def _(t):
    folder = _folder(t, {"train.txt": f"split = 'train' AND {EVEN}", "valid.txt": f"split = 'val' AND {EVEN}", "train_ind.txt": f"split = 'train' AND {ODD}", "valid_ind.txt": f"split = 'val' AND {ODD}", "test_ind.txt": f"split = 'test' AND {ODD}"})
    return _profile(B.five_files(t.spark, folder), "scope", "part")


@query("src6_fact_files", _scopes_sql([("train", "graph", f"split <> 'test' AND {EVEN}"), ("train", "valid", f"split = 'test' AND {EVEN}"), ("inference", "graph", f"split <> 'test' AND {ODD}"), ("inference", "test", f"split = 'test' AND {ODD}")]))
def _(t):
    folder = _folder(t, {"train.txt": f"split <> 'test' AND {EVEN}", "valid.txt": f"split = 'test' AND {EVEN}", "test_graph.txt": f"split <> 'test' AND {ODD}", "test_fact.txt": f"split = 'test' AND {ODD}"})
    return _profile(B.fact_files(t.spark, folder), "scope", "part")


@query("src9_csv_graph", f"WITH {PART}, {LABEL} SELECT node, round(p_retailprice, 2) AS price, p_brand AS brand, label::DOUBLE AS y, CASE WHEN part <> 'val' THEN part END AS part, coalesce(d, 0) AS degree FROM part JOIN lab ON lab.node = p_partkey JOIN nsplit USING (node) LEFT JOIN (SELECT src, count(*) AS d FROM tedges GROUP BY src) g ON src = p_partkey")
def _(t):
    folder = fresh_path(t.spark, "csv")
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.round("p_retailprice", 2).alias("price"), F.col("p_brand").alias("brand"))
    nodes.write.option("header", True).csv(f"{folder}/features.csv")
    t.labels_of_parts().select("node", F.col("label").alias("y")).write.option("header", True).csv(f"{folder}/targets.csv")
    parts = t.split_of_parts()
    parts.select("node", (F.col("part") == "train").alias("train"), F.lit(False).alias("val"), (F.col("part") == "test").alias("test")).write.option("header", True).csv(f"{folder}/split_masks_RL.csv")
    t.part_edges("train").write.option("header", True).csv(f"{folder}/edgelist.csv")
    found, edges = B.tabular(t.spark, folder, "RL", ["price"], ["brand"], "y")
    d = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return found.join(d, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


# Views of bundles.


@query("g14_masks_by_nodes", f"SELECT p_partkey AS node, s AS split_idx, {draw_sql("'g14|' || s || '|' || p_partkey")} % 10 < 3 AS inside FROM part, (VALUES (0::BIGINT), (1), (2)) AS x(s)")
def _(t):
    flat = t.part_nodes().withColumn("s", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    drawn = flat.select("node", "s", (draw("g14|", F.col("s"), "|", F.col("node")) % 10 < 3).alias("m"))
    rows = drawn.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "m"))), lambda x: x.m).alias("mask"))
    return B.masks_long(rows, "s", "mask")  # a row a split: entries are nodes


@query("g20_message_graph", f"WITH {KG} SELECT 'edge' AS kind, h AS src, r AS rel, t AS dst FROM kg WHERE split = 'train' UNION ALL SELECT 'edge', t, r + 6, h FROM kg WHERE split = 'train' UNION ALL SELECT DISTINCT 'query', h, r, t FROM kg WHERE split = 'test'")
def _(t):
    edges, queries = B.message_view(S.flags(t.triples()), 6, "test")
    return edges.select(F.lit("edge").alias("kind"), "*").unionByName(queries.select(F.lit("query").alias("kind"), F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst")))


CATALOG = "SELECT s_suppkey AS dataset, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, s_suppkey % 3 > 0 AS has_visible, CASE WHEN s_suppkey % 5 > 0 THEN n END AS mask_len, CASE WHEN s_suppkey % 7 = 0 THEN n + 1 ELSE n END AS n_edges FROM (SELECT s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)"


@query("pf5_link_prediction", f"SELECT dataset, coalesce(flag, has_visible AND mask_len = n_edges, false) AS link_prediction FROM ({CATALOG})")
def _(t):
    n = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))
    k = F.col("s_suppkey")
    return B.predicts_links(n.select(k.alias("dataset"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("flag"), (k % 3 > 0).alias("has_visible"), F.when(k % 5 > 0, F.col("n")).alias("mask_len"), F.when(k % 7 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n_edges")))


# Catalogs and run tables.


@query("x4_rectangular", "SELECT 'bought' AS matrix, (SELECT max(o_custkey) FROM orders) <> (SELECT max(l_partkey) FROM lineitem) AS rectangular UNION ALL SELECT 'parts', (SELECT max(p_partkey) FROM part) <> (SELECT max(p_partkey) FROM part)")
def _(t):
    bought = t.orders.agg(F.max("o_custkey").alias("rows")).crossJoin(t.lineitem.agg(F.max("l_partkey").alias("cols"))).select(F.lit("bought").alias("matrix"), "rows", "cols")
    parts = t.part.agg(F.max("p_partkey").alias("rows"), F.max("p_partkey").alias("cols")).select(F.lit("parts").alias("matrix"), "rows", "cols")
    return bought.unionByName(parts).select("matrix", (F.col("rows") != F.col("cols")).alias("rectangular"))


@query("x5_required_paths", "SELECT DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'links/' || event_type WHEN event_type = 'purchase' THEN 'kg/' || user_id % 5 ELSE 'nodes/' || event_type || '/raw' END AS path FROM events")
def _(t):
    kind = F.col("event_type")
    path = F.when(kind.isin("click", "view"), F.concat(F.lit("links/"), kind)).when(kind == "purchase", F.concat(F.lit("kg/"), F.col("user_id") % 5)).otherwise(F.concat(F.lit("nodes/"), kind, F.lit("/raw")))
    return t.events.select(path.alias("path")).distinct()


@query("x6_run_summary", "WITH a AS (SELECT event_type AS dataset, count(*) AS runs, round(avg(value), 4) AS recall FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS dataset, round(max(value), 4) AS recall, round(min(value), 4) AS ndcg FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT dataset, runs, coalesce(b.recall, a.recall) AS recall, ndcg FROM a FULL JOIN b USING (dataset)")
def _(t):
    first = t.events.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("runs"), F.round(F.avg("value"), 4).alias("recall"))
    second = t.events.where("event_id % 2 = 1 AND event_type <> 'view'").groupBy(F.col("event_type").alias("dataset")).agg(F.round(F.max("value"), 4).alias("recall"), F.round(F.min("value"), 4).alias("ndcg"))
    return B.combined_runs([first, second], "dataset")


@query("x8_twins", "SELECT n_nationkey AS spec, lower(n_name) AS slug, true AS featured FROM nation UNION ALL SELECT n_nationkey, lower(n_name) || '-nofeat', false FROM nation WHERE n_regionkey <> 2")
def _(t):
    """Each spec, and its twin without features where it has any."""
    spec = t.nation.select(F.col("n_nationkey").alias("spec"), F.lower("n_name").alias("slug"), F.explode(F.when(F.col("n_regionkey") != 2, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("featured"))
    return spec.withColumn("slug", F.when(F.col("featured"), F.col("slug")).otherwise(F.concat("slug", F.lit("-nofeat"))))


@query("x9_candidate_batches", f"WITH {PART}, g AS (SELECT run, split FROM (VALUES (0), (1), (2)) AS a(run), (VALUES ('val'), ('test')) AS b(split)), p AS (SELECT run, split, u AS src, v AS dst FROM pairs JOIN g USING (split)), n AS (SELECT count(*) AS n FROM part) SELECT run, split, src, dst, {draw_sql("'x9|' || run || '|' || split || '|' || src || '|' || dst")} % n AS neg FROM p, n")
def _(t):
    """A corrupted end for every held-out pair, by run and split."""
    n = t.part.agg(F.count("*").alias("n"))  # one row
    grid = t.part_pairs().where("split <> 'train'").withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    neg = draw("x9|", F.col("run"), "|", F.col("split"), "|", F.col("u"), "|", F.col("v")) % F.col("n")
    return grid.crossJoin(F.broadcast(n)).select("run", "split", F.col("u").alias("src"), F.col("v").alias("dst"), neg.alias("neg"))


@query("x10_subsample_report", f"WITH {PART}, {LABEL}, d AS (SELECT src AS node, count(*) AS d FROM edges GROUP BY src) SELECT coalesce(label, -1) AS label, part, count(*) AS nodes, coalesce(sum(d), 0)::BIGINT AS ends, round(avg(coalesce(d, 0)), 6) AS mean_degree FROM lab JOIN nsplit USING (node) LEFT JOIN d USING (node) GROUP BY GROUPING SETS ((coalesce(label, -1), part))")
def _(t):
    d = t.part_edges().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    met = t.labels_of_parts().join(t.split_of_parts(), "node").join(d, "node", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return met.groupBy(F.coalesce("label", F.lit(-1)).alias("label"), "part").agg(F.count("*").alias("nodes"), F.sum("d").alias("ends"), F.round(F.avg("d"), 6).alias("mean_degree"))


@query("f10_run_names", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, date_trunc('hour', ts) AS hour, datediff('day', TIMESTAMP '2024-01-01', ts) AS day FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"), F.date_trunc("hour", "ts").alias("hour"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"))


@query("f13_lists_and_counts", "SELECT p_partkey AS node, list_aggregate(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ',') AS names, printf('%.3fM', p_partkey / 1000.0::DOUBLE) AS size FROM part")
def _(t):
    names = F.filter(F.transform(F.split("p_name", " "), F.trim), lambda x: x != "")
    return t.part.select(F.col("p_partkey").alias("node"), F.nullif(F.array_join(names, ","), F.lit("")).alias("names"), F.format_string("%.3fM", F.col("p_partkey") / F.lit(1000.0)).alias("size"))


@query("f4_bits", "SELECT event_id, bit_count(event_id) AS ones, (event_id & 255) AS low, event_id >> 3 AS shifted, xor(event_id, 1023) AS flipped, CASE WHEN event_id = 0 THEN 0 ELSE floor(log2(event_id))::BIGINT + 1 END AS length FROM events")
def _(t):
    x = F.col("event_id")
    return t.events.select("event_id", F.bit_count(x).alias("ones"), x.bitwiseAND(F.lit(255)).alias("low"), F.shiftright(x, 3).alias("shifted"), x.bitwiseXOR(F.lit(1023)).alias("flipped"), F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("bigint").alias("length"))


@query("st4_task_set", f"SELECT epoch, task, {draw_sql("'st4|' || task || '|kind'")} % 4 AS kind, 16 + {draw_sql("'st4|' || task || '|size'")} % 1000 AS nodes FROM (SELECT c_custkey AS task FROM customer) AS a, (VALUES (0), (1), (2)) AS b(epoch)")
def _(t):
    """Tasks by draws of their number alone: every epoch replays the same set, without a cache."""
    task = F.col("task")
    made = t.customer.select(F.col("c_custkey").alias("task")).select("task", (draw("st4|", task, "|kind") % 4).alias("kind"), (16 + draw("st4|", task, "|size") % 1000).alias("nodes"))
    return made.withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select("epoch", "task", "kind", "nodes")


# Steps with neighbour records, starts and budgets.


@query("j3_steps_beside_records", "WITH x AS (SELECT user_id AS walk_id, event_id AS pos, event_id % 50 AS node, event_id % 3 = 2 AS is_nbr FROM events) SELECT walk_id, pos, node, last_value(CASE WHEN NOT is_nbr THEN node END IGNORE NULLS) OVER (PARTITION BY walk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM x")
def _(t):
    x = t.events.select(F.col("user_id").alias("walk_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 50).alias("node"), (F.col("event_id") % 3 == 2).alias("is_nbr"))
    return WK.previous_beside_records(x)


@query("rw18_start_mix", f"WITH {KG}, te AS (SELECT DISTINCT h FROM kg WHERE split = 'test'), e AS (SELECT h, r, t, row_number() OVER (PARTITION BY r ORDER BY {draw_sql("'rw18|' || h || '|' || t || '|' || r")}, h, t) - 1 AS k, count(*) OVER (PARTITION BY r) AS n FROM kg WHERE split = 'train'), c AS (SELECT 12 // count(DISTINCT r) + 1 AS per FROM kg WHERE split = 'train') SELECT 'query' AS kind, h AS key, i AS j, h AS node FROM te, range(12) AS a(i) UNION ALL SELECT 'random', h, i, {draw_sql("'rw18n|' || h || '|' || i")} % (SELECT count(*) FROM part) FROM te, range(12) AS a(i) UNION ALL SELECT 'edge', r, i, h FROM e, c, range(100) AS a(i) WHERE i < per AND k = i % n")
def _(t):
    kg = t.triples()
    heads = kg.where("split = 'test'").select(F.col("h").alias("key")).distinct()
    edges = kg.where("split = 'train'").select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"))
    return WK.link_starts(heads, edges, t.part.count(), 12, "rw18")


@query("rw20_adaptive_budget", "SELECT n, CASE WHEN n < 1000 THEN 64 // 4 WHEN n < 8000 THEN 64 // 2 ELSE 64 END AS adaptive, least(CASE WHEN f > 16 THEN 64 ELSE 128 END, 128) AS capped FROM (SELECT count(*) AS n, 64 AS f FROM part UNION ALL SELECT count(*), 4 FROM supplier UNION ALL SELECT count(*), 17 FROM customer)")
def _(t):
    sizes = [(t.part, 64), (t.supplier, 4), (t.customer, 17)]
    rows = [x.agg(F.count("*").alias("n"), F.lit(f).alias("f")) for x, f in sizes]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("n", WK.adaptive(F.lit(64), F.col("n")).alias("adaptive"), WK.feature_cap(F.lit(128), F.col("f")).alias("capped"))


# Neighbourhood features of pairs, exactly.


@query(
    "l10_shared_within_hops",
    f"""WITH {PART}, q AS (SELECT u, v FROM pairs WHERE split = 'test'), e AS (SELECT DISTINCT unnest([u, v]) AS node FROM q),
far AS (SELECT node, node AS x, 0 AS d FROM e UNION ALL SELECT node, dst, 1 FROM e JOIN tedges ON src = node UNION ALL SELECT node, b.dst, 2 FROM e JOIN tedges a ON a.src = node JOIN tedges b ON b.src = a.dst),
ball AS (SELECT node, x, min(d) AS d FROM far GROUP BY node, x),
m AS (SELECT u, v, a.d AS da, b.d AS db FROM q JOIN ball a ON a.node = u JOIN ball b ON b.node = v AND b.x = a.x)
SELECT u AS src, v AS dst, """ + ", ".join(f"count(*) FILTER (WHERE da <= {i} AND db <= {j}) AS n{i}{j}" for i in (1, 2) for j in (1, 2)) + " FROM q LEFT JOIN m USING (u, v) GROUP BY u, v",
)
def _(t):
    pairs = t.part_pairs().where("split = 'test'").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return L.shared_within_hops(pairs, t.part_edges("train"), 2)


# Samplers. Those that reject draws are tested by their moments.

_U = {k + more: draw_sql(f"'gn16|{k}|' || p_partkey || '{more}'") + " / 4294967296.0::DOUBLE" for k, more in [*((k, "") for k in "abcdefgh"), ("d", "|default"), ("f", "|which")]} | {f"m{k}": draw_sql(f"'gn16|m|' || p_partkey % 10 || '|logit{k}'") + " / 4294967296.0::DOUBLE" for k in range(3)}
_E = [f"exp(-1 + {_U[f'm{k}']} * 2)" for k in range(3)]


@query(
    "gn16_samplers",
    f"""SELECT p_partkey AS node, round(2 + {_U['a']} * 3, 9) AS between, round(exp(ln(0.01::DOUBLE) + {_U['b']} * (ln(10::DOUBLE) - ln(0.01::DOUBLE))), 9) AS log_between, (3 + floor({_U['c']} * 8))::BIGINT AS whole,
  CASE WHEN {_U['d|default']} < 0.25 THEN 7 ELSE 20 + floor({_U['d']} * 11) END::BIGINT AS whole_or_default, ['x', 'y', 'z'][floor({_U['e']} * 3)::INT + 1] AS choice,
  round(CASE WHEN {_U['f|which']} < 0.4 THEN exp(ln(1::DOUBLE) + {_U['f']} * (ln(2::DOUBLE) - ln(1::DOUBLE))) ELSE exp(ln(100::DOUBLE) + {_U['f']} * (ln(200::DOUBLE) - ln(100::DOUBLE))) END, 9) AS mixed,
  CASE WHEN {_U['g']} * 10 < 1 THEN 'x' WHEN {_U['g']} * 10 < 4 THEN 'y' ELSE 'z' END AS weighted,
  CASE WHEN {_U['h']} * ({' + '.join(_E)}) < {_E[0]} THEN 'x' WHEN {_U['h']} * ({' + '.join(_E)}) < {_E[0]} + {_E[1]} THEN 'y' ELSE 'z' END AS by_group FROM part""",
)
def _(t):
    def key(name):
        return (f"gn16|{name}|", F.col("node"))

    group = ("gn16|m|", F.col("node") % 10)
    return t.part_nodes().select(
        "node", F.round(SA.between(key("a"), 2, 5), 9).alias("between"), F.round(SA.log_between(key("b"), 0.01, 10), 9).alias("log_between"), SA.whole_between(key("c"), 3, 10).alias("whole"),
        SA.whole_or_default(key("d"), 20, 30, 7, 0.25).alias("whole_or_default"), SA.choice(key("e"), ["x", "y", "z"]).alias("choice"),
        F.round(SA.mixed_log_between(key("f"), (1, 2), (100, 200), 0.4), 9).alias("mixed"), SA.weighted_choice(key("g"), ["x", "y", "z"], [1, 3, 6]).alias("weighted"),
        SA.meta_choice(key("h"), group, ["x", "y", "z"], -1, 1).alias("by_group"),
    )


# Array files: written by slices, committed at once, read by slices.


_NUMBERS = "array_join(transform(values, v -> cast(v AS bigint)), ' ')"


@query("src10_array_masks", f"WITH {PART}, m AS (SELECT p_partkey AS node, s AS split, {draw_sql("'src10|' || p_partkey || '|' || s")} % 10 < 3 AS value FROM part, range(10) AS a(s)), n AS (SELECT count(*) AS n FROM part) SELECT form, node, split::INT AS split, value FROM m, (VALUES ('nodes'), ('splits')) AS f(form) UNION ALL SELECT 'edges', src, dst::INT, true FROM edges")
def _(t):
    """Ten splits' masks as [N, 10] and as [10, N], and an edge list with each edge twice, through array files."""
    path, n = fresh_path(t.spark, "arrays"), t.part.count()
    drawn = t.part_nodes().select("node", *[(draw("src10|", F.col("node"), f"|{s}") % 10 < 3).cast("double").alias(f"s{s}") for s in range(10)])
    arrays.write_array(drawn.select(F.col("node").alias("i"), F.array(*[f"s{s}" for s in range(10)]).alias("values")), path, "nodes", "bool")
    turned = drawn.select("node", F.posexplode(F.array(*[f"s{s}" for s in range(10)])).alias("i", "v")).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "v"))), lambda x: x["v"]).alias("values"))
    arrays.write_array(turned, path, "splits", "bool")  # ten rows of N bytes: what the form asks
    edges = t.part_edges()
    placed = written(dense_ids(edges.withColumn("k", F.col("src") * n + F.col("dst")), "k", "i"), "edges")
    twice = placed.unionByName(placed.withColumn("i", F.col("i") + placed.count()))
    arrays.write_array(twice.select("i", F.array("src", "dst").alias("values")), path, "edgelist", "int64")
    out = arrays.coalesced_edges(arrays.read_arrays(t.spark, path, "edgelist")).select(F.lit("edges").alias("form"), F.col("src").alias("node"), F.col("dst").cast("int").alias("split"), F.lit(True).alias("value"))
    for form in ("nodes", "splits"):
        out = out.unionByName(arrays.masks_by_node(arrays.read_arrays(t.spark, path, form), n).select(F.lit(form).alias("form"), "node", "split", "value"))
    return out


@query("snk5_bundle", f"""WITH {PART}, {LABEL}, p AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS i FROM pairs)
SELECT 'features' AS array, p_partkey AS i, p_size || ' ' || round(p_retailprice)::BIGINT AS numbers FROM part UNION ALL SELECT 'targets', node, coalesce(label, -1)::VARCHAR FROM lab UNION ALL SELECT 'edgelist', i, u || ' ' || v FROM p
UNION ALL SELECT s, node, (part = s)::INT::VARCHAR FROM nsplit, (VALUES ('train'), ('val'), ('test')) AS a(s)""")
def _(t):
    """The labelled part graph as a bundle of arrays, read back."""
    path = fresh_path(t.spark, "bundle")
    features = t.part.select(F.col("p_partkey").alias("node"), F.array(F.col("p_size").cast("double"), F.round("p_retailprice").cast("double")).alias("values"))
    arrays.write_bundle(path, features, t.labels_of_parts(), t.part_edges(), t.split_of_parts())
    return arrays.read_arrays(t.spark, path).select("array", "i", F.expr(_NUMBERS).alias("numbers"))
