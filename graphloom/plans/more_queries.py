"""Further queries: inductive sources, pair theta joins, pipelines, feature plans, statistic rows, samplers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..functions.draws import draw, draw_sql
from ..operators import algorithms as A
from ..operators import features as FE
from ..operators import generate as GN
from ..operators import graph as G
from ..operators import links as L
from ..operators import reports as RP
from ..operators import splits as S
from ..operators import statistics as ST
from ..operators import walks as WK
from ..sources import texts
from ..sources.fixtures import BIP, KG, LABEL, PART, RUNS
from .registry import query

# Filters and scalar functions.


@query("pf14_metric_names", "WITH m AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'mrr' WHEN 1 THEN 'mrr/' || event_type WHEN 2 THEN 'hits@10/' || event_type ELSE 'num_queries/' || event_type END AS metric FROM events) SELECT metric, regexp_matches(metric, '^(mrr|hits@[0-9]+|num_queries)/') AS per_relation FROM m")
def _(t):
    u, e = F.col("user_id") % 4, F.col("event_type")
    name = F.when(u == 0, "mrr").when(u == 1, F.concat(F.lit("mrr/"), e)).when(u == 2, F.concat(F.lit("hits@10/"), e)).otherwise(F.concat(F.lit("num_queries/"), e))
    return t.events.select(name.alias("metric")).distinct().select("metric", F.col("metric").rlike("^(mrr|hits@[0-9]+|num_queries)/").alias("per_relation"))


@query("f1_rounding", "SELECT event_id, round(log2(event_id + 1), 9) AS log2, round(ln(event_id + 1), 9) AS ln, round(sqrt(event_id), 9) AS root, round_even(event_id / 4.0, 0)::BIGINT AS even, floor(event_id / 3.0)::BIGINT AS low, ceil(event_id / 3.0)::BIGINT AS high, greatest(10, least(500, event_id)) AS clipped FROM events")
def _(t):
    x = F.col("event_id")
    return t.events.select("event_id", F.round(F.log2(x + 1), 9).alias("log2"), F.round(F.log1p(x), 9).alias("ln"), F.round(F.sqrt(x), 9).alias("root"), F.bround(x / F.lit(4.0)).cast("bigint").alias("even"), F.floor(x / F.lit(3.0)).alias("low"), F.ceil(x / F.lit(3.0)).alias("high"), F.greatest(F.lit(10), F.least(F.lit(500), x)).alias("clipped"))


@query("f6_strings", "SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, string_split(p_name, ' ')[1] AS head, upper(p_brand) AS brand FROM part")
def _(t):
    return t.part.select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "-")).alias("slug"), F.split("p_name", " ")[0].alias("head"), F.upper("p_brand").alias("brand"))


@query("f7_arrays", "SELECT vec_id, list_position(list_sort(embedding), list_max(embedding)) AS place, len(list_distinct(list_transform(embedding, lambda e: floor(e)))) AS kinds, round(list_sum(list_transform(embedding[1:8], lambda e: e::DOUBLE)), 5) AS head, round(list_reverse(embedding)[1]::DOUBLE, 6) AS last FROM embeddings")
def _(t):
    e = F.col("embedding")
    head = F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return t.embeddings.select("vec_id", F.array_position(F.sort_array(e), F.array_max(e)).alias("place"), F.size(F.array_distinct(F.transform(e, lambda v: F.floor(v)))).alias("kinds"), F.round(head, 5).alias("head"), F.round(F.reverse(e)[0].cast("double"), 6).alias("last"))


@query("f8_flattened_map", f"WITH {RUNS}, s AS (SELECT dataset, avg(value) AS mean, stddev_pop(value) AS std FROM runs GROUP BY dataset) SELECT dataset, 'score' AS metric, round(mean, 6) AS value FROM s UNION ALL SELECT dataset, 'score_std', round(std, 6) FROM s")
def _(t):
    s = t.runs().groupBy("dataset").agg(F.create_map(F.lit("score"), F.avg("value"), F.lit("score_std"), F.stddev_pop("value")).alias("m"))
    return s.select("dataset", F.explode("m").alias("metric", "value")).withColumn("value", F.round("value", 6))


# Joins.


@query("j13_geometric_graph", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 0.1")
def _(t):
    """Within a radius: points meet in cells of that width and their neighbours, never all pairs."""
    r = 0.1
    p = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    cell = p.select("id", "x", "y", F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = cell.withColumn("s", steps).select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    met = cell.join(near, ["cx", "cy"]).where("id < dst")
    return met.where(F.sqrt(F.pow(F.col("x") - F.col("bx"), 2.0) + F.pow(F.col("y") - F.col("by"), 2.0)) < r).select(F.col("id").alias("src"), "dst")


@query("j18_forbidden_counts", f"WITH {PART} SELECT src, (SELECT count(*) FROM part) - 1 - count(DISTINCT dst) AS free FROM edges WHERE src IN (SELECT src FROM xedges) GROUP BY src")
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    taken = t.part_edges().join(t.part_edges("test").select("src").distinct(), "src", "left_semi").groupBy("src").agg(F.countDistinct("dst").alias("d"))
    return taken.crossJoin(F.broadcast(n)).select("src", (F.col("n") - 1 - F.col("d")).alias("free"))


@query("j19_gathered_ids", "WITH k AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_size % 2 = 0) SELECT p_partkey AS node, coalesce(new, -1) AS new FROM part LEFT JOIN k ON node = p_partkey")
def _(t):
    from ..operators.scans import dense_ids

    kept = dense_ids(t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("node")), "node", "new")
    return t.part_nodes().join(kept, "node", "left").select("node", F.coalesce("new", F.lit(-1)).alias("new"))


@query("w7_sorted_triples", f"WITH {KG} SELECT h, r, t, row_number() OVER (PARTITION BY h ORDER BY r, t) AS place FROM kg")
def _(t):
    return t.triples().select("h", "r", "t", F.row_number().over(Window.partitionBy("h").orderBy("r", "t")).alias("place"))


@query("w5_anonymised_with_marks", "WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS v FROM events), f AS (SELECT user_id, v, min(event_id) AS first FROM x WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT user_id, v, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS k FROM f) SELECT event_id, coalesce(k, -1) AS anon FROM x LEFT JOIN r USING (user_id, v)")
def _(t):
    x = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("v"))
    first = x.where("v IS NOT NULL").groupBy("user_id", "v").agg(F.min("event_id").alias("first"))
    ranked = first.select("user_id", "v", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")).alias("k"))
    return x.join(ranked, ["user_id", "v"], "left").select("event_id", F.coalesce("k", F.lit(-1)).alias("anon"))


# Aggregates.


@query("ag6_merged_partials", f"WITH {RUNS} SELECT metric, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS best FROM runs GROUP BY metric")
def _(t):
    ranks = t.runs().groupBy("seed", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("best"))
    return ranks.groupBy("metric").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.round(F.max("best"), 6).alias("best"))


@query("ag11_grid_means", f"WITH {RUNS}, p AS (SELECT dataset, split_idx, seed, avg(value) AS v FROM runs GROUP BY ALL), b AS (SELECT dataset, split_idx, max(v) AS v FROM p GROUP BY ALL) SELECT dataset, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM b GROUP BY dataset")
def _(t):
    per = t.runs().groupBy("dataset", "split_idx", "seed").agg(F.avg("value").alias("v"))
    best = per.groupBy("dataset", "split_idx").agg(F.max("v").alias("value")).withColumn("metric", F.lit("best"))
    return RP.over_seeds(best).drop("metric")


@query("ag17_masked_uniques", f"WITH {LABEL} SELECT count(DISTINCT l_partkey) AS nodes, count(DISTINCT l_partkey) FILTER (WHERE part = 'train') AS train FROM lineitem JOIN nsplit ON node = l_partkey")
def _(t):
    seen = t.lineitem.select(F.col("l_partkey").alias("node")).join(t.split_of_parts(), "node")
    return seen.agg(F.countDistinct("node").alias("nodes"), F.countDistinct(F.when(F.col("part") == "train", F.col("node"))).alias("train"))


# Sources.


def _tokens(t, where):
    rows = t.triples().where(where)
    return rows.select(F.lit(0).alias("file"), (F.col("h") * 100000 + F.col("t") * 10 + F.col("r")).alias("line_no"), F.concat_ws(" ", F.concat(F.lit("e"), "h"), F.concat(F.lit("e"), "t"), F.concat(F.lit("r"), "r")).alias("value"))


@query("src4_src5_inductive_scopes", f"WITH {KG}, a AS (SELECT h, r, t FROM kg WHERE split = 'train' AND h % 2 = 0), b AS (SELECT h, r, t FROM kg WHERE split = 'test' AND h % 2 = 1) SELECT 'train' AS scope, (SELECT count(*) FROM (SELECT h FROM a UNION SELECT t FROM a)) AS entities, (SELECT count(*) FROM a) AS triples UNION ALL SELECT 'inference', (SELECT count(*) FROM (SELECT h FROM b UNION SELECT t FROM b)), (SELECT count(*) FROM b)")
def _(t):
    out = None
    for scope, where in (("train", "split = 'train' AND h % 2 = 0"), ("inference", "split = 'test' AND h % 2 = 1")):
        found = texts.triples(_tokens(t, where), order="htr")
        row = texts.vocabulary(found).agg(F.count("*").alias("entities")).crossJoin(found.agg(F.count("*").alias("triples"))).select(F.lit(scope).alias("scope"), "entities", "triples")
        out = row if out is None else out.unionByName(row)
    return out


@query("src14_aliases", "SELECT n_name AS dataset FROM nation")
def _(t):
    """Regions as group names of their nations, by any case, and a nation named twice."""
    groups: dict[str, list[str]] = {}
    for region, nation in t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect():  # two small domains
        groups.setdefault(region.title(), []).append(nation)
    names = texts.expand_aliases([*map(str.lower, groups), *sorted(sum(groups.values(), []))[:1]], groups)
    return t.spark.createDataFrame([(n,) for n in names], "dataset string")


@query("src19_nested_snapshots", f"WITH {PART}, {LABEL}, s AS (SELECT 'train' AS snapshot, node FROM nsplit WHERE part = 'train' UNION ALL SELECT 'val', node FROM nsplit WHERE part <> 'test' UNION ALL SELECT 'test', node FROM nsplit) SELECT a.snapshot, count(*) AS edges FROM edges JOIN s a ON src = a.node JOIN s b ON dst = b.node AND a.snapshot = b.snapshot GROUP BY a.snapshot")
def _(t):
    parts = t.split_of_parts()
    out = None
    for name, where in (("train", "part = 'train'"), ("val", "part <> 'test'"), ("test", "true")):
        own = G.induced_subgraph(t.part_edges(), parts.where(where).select("node")).agg(F.count("*").alias("edges")).select(F.lit(name).alias("snapshot"), "edges")
        out = own if out is None else out.unionByName(own)
    return out.where("edges > 0")


@query("src9_tabular_graph", f"WITH {PART}, {LABEL} SELECT node, p_size AS numerical, round(avg(l_discount), 6) AS fraction, p_brand AS category, label, part FROM part JOIN lab ON lab.node = p_partkey JOIN nsplit USING (node) LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    share = t.lineitem.groupBy(F.col("l_partkey").alias("node")).agg(F.round(F.avg("l_discount"), 6).alias("fraction"))
    base = t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("numerical"), F.col("p_brand").alias("category"))
    return base.join(share, "node", "left").join(t.labels_of_parts(), "node").join(t.split_of_parts(), "node")


# Walk pipelines and mixes.


_WALKS, _T = 64, 2
_SLOTS = 3 * _WALKS


def _starts_sql(mode: str) -> str:
    places = "\n".join(f"{kind}p AS (SELECT node, row_number() OVER (ORDER BY {draw_sql(f"'rw19|{kind}|' || node")}, node) - 1 AS k, count(*) OVER () AS n FROM nsplit WHERE {where})," for kind, where in (("train", "part = 'train'"), ("batch", "part = 'test'"), ("focus", "part = 'val'")))
    low, high = int(1.5 * _WALKS * _T), -int(-1.5 * _WALKS * _T // 1)

    def drawn(kind, first, count):
        return f"SELECT (row % {_T})::INT AS refinement, row // {_T} AS slot, '{kind}' AS kind, node FROM unnest(range({first}, {first + count})) AS u(row) JOIN {kind}p ON k = {draw_sql(f"'rw19|{kind}|' || row")} % n"

    if mode == "default":
        out = drawn("train", 0, low) + " UNION ALL " + drawn("batch", low, high)
    elif mode == "train_only":
        out = drawn("train", 0, _SLOTS * _T)
    else:
        kind = "focus" if mode == "train_chunk" else "batch"
        out = f"SELECT r::INT AS refinement, slot, '{kind}' AS kind, node FROM unnest(range(0, {_T})) AS a(r), unnest(range(0, {_SLOTS})) AS b(slot) JOIN {kind}p ON k = (slot + {draw_sql(f"'rw19|{kind}|' || r || '|' || (slot // n)")}) % n"
    return f"WITH {LABEL}, {places} x AS (SELECT 1) {out}"


for _mode in WK.MODES:

    @query("rw19_start_mix" if _mode == "default" else f"rw19_{_mode}", _starts_sql(_mode))
    def _(t, mode=_mode):
        """Training nodes, a batch of all test nodes, and validation nodes as the chunk to walk from."""
        train, batch, focus = (t.split_of_parts().where(f"part = '{p}'").select("node") for p in ("train", "test", "val"))
        return WK.start_nodes(mode, train, batch, _WALKS, _T, "rw19|", focus)


@query("rw17_typed_anonymous_walks", f"""WITH RECURSIVE {KG}, sides AS (SELECT h AS src, t AS dst FROM kg WHERE split = 'train' UNION SELECT t, h FROM kg WHERE split = 'train'),
adjl AS (SELECT src, list(dst ORDER BY dst) AS l, count(*) AS d FROM sides GROUP BY src),
w(walk, pos, node, prev) AS (SELECT p_partkey, 0, p_partkey, NULL::BIGINT FROM part UNION ALL SELECT walk, pos + 1, CASE WHEN d IS NULL THEN node WHEN d = 1 OR prev IS NULL THEN l[{draw_sql("'rw17|' || walk || '|' || (pos + 1)")} % d + 1] ELSE list_filter(l, lambda y: y <> prev)[{draw_sql("'rw17|' || walk || '|' || (pos + 1)")} % greatest(d - 1, 1) + 1] END, CASE WHEN d IS NULL THEN NULL ELSE node END FROM w LEFT JOIN adjl ON src = node WHERE pos < 4),
m AS (SELECT walk, pos, node, lag(node) OVER (PARTITION BY walk ORDER BY pos) AS p FROM w),
e AS (SELECT h AS a, t AS b, r, 0 AS dir FROM kg WHERE split = 'train' UNION ALL SELECT t, h, r, 1 FROM kg WHERE split = 'train'),
ty AS (SELECT walk, pos, r, dir FROM (SELECT walk, pos, r, dir, row_number() OVER (PARTITION BY walk, pos ORDER BY {draw_sql("'rw17t|' || walk || '|' || pos || '|' || coalesce(r, -1) || '|' || coalesce(dir, -1)")}, r, dir) AS k FROM m LEFT JOIN e ON p = a AND node = b) WHERE k = 1),
f AS (SELECT walk, node, min(pos) AS first FROM w GROUP BY walk, node), an AS (SELECT walk, node, dense_rank() OVER (PARTITION BY walk ORDER BY first) AS anon FROM f)
SELECT walk AS walk_id, pos, anon, r AS rel, dir FROM w JOIN an USING (walk, node) JOIN ty USING (walk, pos)""")
def _(t):
    train = t.triples().where("split = 'train'")
    edges = G.symmetrise(train.select(F.col("h").alias("src"), F.col("t").alias("dst")))
    walks = WK.anonymised(WK.walk(t.part_nodes().select(F.col("node").alias("walk_id"), "node"), edges, 4, "rw17", backtrack=False))
    places = walks.select("walk_id", F.posexplode(F.arrays_zip("path", "anon")).alias("pos", "x")).select("walk_id", "pos", F.col("x.path").alias("node"), F.col("x.anon").alias("anon"))
    return places.join(WK.step_types(places.drop("anon"), train, "rw17t"), ["walk_id", "pos"]).select("walk_id", "pos", "anon", "rel", "dir")


# Iterative algorithms.


@query(
    "it4_bounded_distance",
    f"""WITH {PART}, q AS (SELECT u, v FROM pairs WHERE split = 'test'), a0 AS (SELECT DISTINCT u AS node FROM q), b0 AS (SELECT DISTINCT v AS node FROM q),
fa AS (SELECT node, node AS x, 0 AS d FROM a0 UNION ALL SELECT node, dst, 1 FROM a0 JOIN tedges ON src = node UNION ALL SELECT node, y.dst, 2 FROM a0 JOIN tedges x ON x.src = node JOIN tedges y ON y.src = x.dst),
fb AS (SELECT node, node AS x, 0 AS d FROM b0 UNION ALL SELECT node, dst, 1 FROM b0 JOIN tedges ON src = node),
m AS (SELECT u, v, min(a.d + b.d) AS hops FROM q JOIN (SELECT node, x, min(d) AS d FROM fa GROUP BY ALL) a ON a.node = u JOIN fb b ON b.node = v AND b.x = a.x GROUP BY u, v)
SELECT u AS a, v AS b, hops FROM q LEFT JOIN m USING (u, v)""",
)
def _(t):
    q = t.part_pairs().where("split = 'test'").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return A.bounded_distance(q, t.part_edges("train"), 3).toDF("a", "b", "hops")


@query("it11_one_step", f"WITH {KG} SELECT t AS node, round(sum(r + 1.0::DOUBLE), 6) AS x FROM kg WHERE split = 'train' GROUP BY t")
def _(t):
    """One step from all heads at once, a relation's vector being its number."""
    start = t.triples().select(F.col("h").alias("node")).distinct().withColumn("x", F.lit(1.0))
    met = t.triples().where("split = 'train'").join(start, F.col("h") == F.col("node"))
    return met.groupBy(F.col("t").alias("node")).agg(F.round(F.sum(F.col("x") * (F.col("r") + 1)), 6).alias("x"))


@query("it5_eccentricity", f"WITH RECURSIVE {PART}, b(seed, node, hop) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey IN (SELECT src FROM edges ORDER BY src LIMIT 1) UNION SELECT seed, dst, hop + 1 FROM b JOIN edges ON src = node WHERE hop < 14), h AS (SELECT node, min(hop) AS hop FROM b GROUP BY node) SELECT max(hop) AS eccentricity, count(*) AS reached FROM h")
def _(t):
    edges = t.part_edges()
    seed = edges.agg(F.min("src").alias("node"))
    return A.hops(edges, seed).agg(F.max("hop").alias("eccentricity"), F.count("*").alias("reached"))


@query("it5_diameter", f"WITH RECURSIVE {PART}, far(s, node, hop) AS (SELECT node, node, 0 FROM (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'it5|' || p_partkey")}, p_partkey) AS nth FROM part) WHERE nth <= 200 UNION SELECT s, dst, hop + 1 FROM far JOIN edges ON src = node WHERE hop < 7), least AS (SELECT s, node, min(hop) AS hop FROM far GROUP BY s, node) SELECT max(hop) AS diameter, least((SELECT count(*) FROM part), 200) AS sources, count(*) AS reached FROM least")
def _(t):
    return A.diameter(t.part_nodes(), t.part_edges(), 200, "it5|")


@query("it13_intensity", "WITH p AS (SELECT p_retailprice / 2000 AS p, (SELECT count(*) FROM part) AS size FROM part), s AS (SELECT p, size, count(*) OVER (ORDER BY p) AS n, sum(p) OVER (ORDER BY p) AS s FROM p) SELECT round(max((size / 5.0::DOUBLE - (size - n)) / s), 6) AS c FROM s")
def _(t):
    """The factor c with sum(min(c p, 1)) = a fifth of the rows."""
    return FE.intensity(t.part.select((F.col("p_retailprice") / 2000).alias("p")), "p", t.part.count() / 5).select(F.round("c", 6).alias("c"))


# Feature plans.


@query("fe9_typed_columns", "SELECT 'p_size' AS name, 'numerical' AS kind UNION ALL SELECT 'p_brand', 'categorical' UNION ALL SELECT 'flag', 'categorical' UNION ALL SELECT 'share', 'fraction'")
def _(t):
    """A fraction column of two values is categorical; constant categorical columns are left out."""
    x = t.part.select("p_size", "p_brand", (F.col("p_size") % 2).cast("double").alias("flag"), (F.col("p_size") / 50).alias("share"), F.lit("one").alias("constant"))
    given = {"p_size": "numerical", "p_brand": "categorical", "flag": "fraction", "share": "fraction", "constant": "categorical"}
    counts = x.agg(*[F.countDistinct(c).alias(c) for c in x.columns]).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, x.columns)), F.array(*x.columns))).alias("name", "n"))
    kind = F.create_map(*[F.lit(v) for kv in given.items() for v in kv])[F.col("name")]
    out = counts.select("name", "n", F.when((kind == "fraction") & (F.col("n") == 2), "categorical").otherwise(kind).alias("kind"))
    return out.where(~((F.col("kind") == "categorical") & (F.col("n") <= 1))).select("name", "kind")


@query("fe10_pipeline", "WITH p AS (SELECT p_partkey AS node, [p_size::DOUBLE, 1.0, p_retailprice] AS v FROM part), x AS (SELECT node, i - 1 AS i, v[i] AS x FROM p, (VALUES (1), (3)) AS u(i)), s AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-12) AS s FROM x WHERE node % 2 = 0 GROUP BY i) SELECT node, i, round(greatest(-100, least(100, (x - m) / s)), 6) AS z FROM x JOIN s USING (i)")
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("node"), F.array(F.col("p_size").cast("double"), F.lit(1.0), F.col("p_retailprice")).alias("v"))
    x = FE.elements(rows, "node", "v")
    kept = x.join(F.broadcast(FE.constant_columns(x)), "i", "left_anti")  # a row a column
    return FE.z_scores(kept, F.col("node") % 2 == 0, 100.0).select("node", "i", F.round("z", 6).alias("z"))


@query("fe17_feature_tiers", "SELECT n, CASE WHEN n <= 1000 THEN 100 WHEN n <= 10000 THEN 50 ELSE 20 END AS most FROM (SELECT count(*) AS n FROM part UNION ALL SELECT count(*) FROM lineitem)")
def _(t):
    n = t.part.agg(F.count("*").alias("n")).unionByName(t.lineitem.agg(F.count("*").alias("n")))
    return n.select("n", F.when(F.col("n") <= 1000, 100).when(F.col("n") <= 10000, 50).otherwise(20).alias("most"))


# Statistic rows.


def _all_columns() -> str:
    return ", ".join(f"NULL::{'VARCHAR' if c in ('complexity', 'synthetic_task', 'prior_source') else 'DOUBLE'} AS {c}" for c in ST.METRIC_COLUMNS)


TRI = "tri AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND a.dst < b.dst)"


@query(
    "m16_metric_row",
    f"""WITH RECURSIVE {PART}, {KG}, {BIP}, {LABEL}, {TRI}, k AS (SELECT node, count(*) AS k FROM (SELECT unnest([x, y, z]) AS node FROM tri) GROUP BY node), d AS (SELECT src AS node, count(*) AS d FROM edges GROUP BY src),
far(s, node, hop) AS (SELECT node, node, 0 FROM (SELECT p_partkey AS node, row_number() OVER (ORDER BY {draw_sql("'bfs|' || p_partkey")}, p_partkey) AS nth FROM part) WHERE nth <= 200 UNION SELECT s, dst, hop + 1 FROM far JOIN edges ON src = node WHERE hop < 7),
x AS (SELECT unnest([p_size, p_retailprice])::DOUBLE AS x FROM part), n AS (SELECT count(*) / sum(count(*)) OVER () AS p, count(*) OVER () AS c FROM lab WHERE label IS NOT NULL GROUP BY label),
e AS (SELECT a.label AS x, b.label AS y FROM edges JOIN lab a ON src = a.node JOIN lab b ON dst = b.node WHERE src <= dst AND a.label IS NOT NULL AND b.label IS NOT NULL), ep AS (SELECT count(*) / (SELECT count(*) FROM e)::DOUBLE AS p FROM e WHERE x = y GROUP BY x), es AS (SELECT sum(sqrt(p)) AS s, sum(p) AS c FROM ep),
rel AS (SELECT count(*) AS n, count(DISTINCT t) / count(DISTINCT h)::DOUBLE AS ratio FROM kg GROUP BY r), bs AS (SELECT src, dst, {draw_sql("'m16|' || src || '|' || dst")} % 10 AS z FROM bip),
um AS (SELECT avg(c_acctbal / 1000) AS a, avg(c_nationkey) AS b FROM customer), im AS (SELECT avg(p_retailprice / 1000) AS a, avg(p_size) AS b FROM part)
SELECT {_all_columns()} WHERE false
UNION ALL BY NAME SELECT 'parts' AS prior_source, 0 AS graph_idx, (SELECT count(*) FROM part) AS num_nodes, (SELECT count(*) FROM pairs) AS num_edges,
  (SELECT round(avg(CASE WHEN d > 1 THEN 2 * coalesce(k, 0) / (d * (d - 1))::DOUBLE ELSE 0 END), 9) FROM part LEFT JOIN d ON d.node = p_partkey LEFT JOIN k ON k.node = p_partkey) AS clustering_coeff,
  (SELECT max(h) FROM (SELECT min(hop) AS h FROM far GROUP BY s, node)) AS approx_diameter, 2 AS num_features, (SELECT round(var_samp(x), 9) FROM x) AS feature_variance, (SELECT round(avg((x = 0)::INT), 9) FROM x) AS feature_sparsity,
  (SELECT max(label) + 1 FROM lab) AS num_classes, (SELECT round(-sum(p * log2(p)) / log2(max(c)), 9) FROM n) AS class_balance, (SELECT round(avg((x = y)::INT), 9) FROM e) AS edge_homophily, (SELECT round((s * s - 1) / (s * s + 1 - 2 * c), 9) FROM es) AS unbiased_homophily,
  (SELECT round(avg((part = 'train')::INT), 9) FROM nsplit) AS pct_train_nodes, (SELECT round(avg((part = 'val')::INT), 9) FROM nsplit) AS pct_val_nodes, (SELECT round(avg((part = 'test')::INT), 9) FROM nsplit) AS pct_test_nodes,
  (SELECT round(avg((split = 'train')::INT), 9) FROM pairs) AS pct_train_edges, (SELECT round(avg((split = 'val')::INT), 9) FROM pairs) AS pct_val_edges, (SELECT round(avg((split = 'test')::INT), 9) FROM pairs) AS pct_test_edges,
  (SELECT round(avg(greatest(0, (SELECT count(*) FROM part) - 1 - coalesce(d, 0))), 9) FROM (SELECT DISTINCT src FROM xedges) LEFT JOIN (SELECT src, count(*) AS d FROM tedges GROUP BY src) USING (src)) AS lp_effective_candidate_pool_mean
UNION ALL BY NAME SELECT 'kg' AS prior_source, 1 AS graph_idx, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS num_nodes, (SELECT count(DISTINCT (h, t)) FROM kg) AS num_edges,
  (SELECT round(avg((split = 'train')::INT), 9) FROM kg) AS pct_train_edges, (SELECT round(avg((split = 'val')::INT), 9) FROM kg) AS pct_val_edges, (SELECT round(avg((split = 'test')::INT), 9) FROM kg) AS pct_test_edges,
  (SELECT count(*) FROM rel) AS num_relations, (SELECT min(n) FROM rel) AS relation_count_min, (SELECT max(n) FROM rel) AS relation_count_max, (SELECT round(avg(ratio), 9) FROM rel) AS relation_in_out_entity_ratio_avg
UNION ALL BY NAME SELECT 'purchases' AS prior_source, 2 AS graph_idx, (SELECT count(*) FROM customer) AS num_users, (SELECT count(*) FROM part) AS num_items,
  (SELECT round(count(*) / ((SELECT count(*) FROM customer) * (SELECT count(*) FROM part))::DOUBLE, 12) FROM bs WHERE z < 8) AS bipartite_density,
  (SELECT round(avg((dst NOT IN (SELECT dst FROM bs WHERE z < 8))::INT), 9) FROM bs WHERE z >= 8) AS cold_start_exposure, (SELECT round(sqrt((um.a - im.a) ** 2 + (um.b - im.b) ** 2), 6) FROM um, im) AS bipartite_feature_side_distance""",
)
def _(t):
    labels, edges, pairs = t.labels_of_parts(), t.part_edges(), t.part_pairs()
    n = t.part.agg(F.count("*").alias("n"))
    features = t.part.select(F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x"))
    parts = ST.metric_row(
        "parts", ST.structure(t.part_nodes(), edges), ST.feature_profile(features, "x"), ST.label_profile(labels, edges),
        ST.shares(t.split_of_parts(), "part", "nodes"), ST.shares(pairs, "split", "edges"), ST.candidate_pool(n, t.part_edges("train"), t.part_edges("test")),
    )
    kg = t.triples()
    size = n.crossJoin(t.supplier.agg(F.count("*").alias("m"))).select((F.col("n") + F.col("m")).alias("num_nodes"))
    tied = kg.select("h", "t").distinct().agg(F.count("*").alias("num_edges"))
    triples = ST.metric_row("kg", size, tied, ST.shares(kg, "split", "edges"), ST.relation_profile(kg), place=1)
    drawn = t.purchases().withColumn("z", draw("m16|", F.col("src"), "|", F.col("dst")) % 10)
    users = t.customer.select(F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"))
    items = t.part.select(F.array(F.col("p_retailprice") / 1000, F.col("p_size").cast("double")).alias("x"))
    bought = ST.metric_row("purchases", ST.bipartite_profile(users, items, drawn.where("z < 8"), drawn.where("z >= 8"), "x"), place=2)
    return parts.unionByName(triples).unionByName(bought)


@query("m15_cold_start_and_means", f"WITH {BIP}, d AS (SELECT dst, count(*) AS d FROM bip GROUP BY dst) SELECT count(*) AS items, count(*) FILTER (WHERE d = 1) AS once, round(avg(d), 6) AS mean FROM d")
def _(t):
    d = t.purchases().groupBy("dst").agg(F.count("*").alias("d"))
    return d.agg(F.count("*").alias("items"), F.count_if(F.col("d") == 1).alias("once"), F.round(F.avg("d"), 6).alias("mean"))


@query("m19_mlp_probe")
def _(t):
    """Accuracy of a small perceptron on vectors; trained on even ids, measured on odd ones."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=[64, 32, 10], seed=1, maxIter=30).fit(data.where("vec_id % 2 = 0"))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return model.transform(data.where("vec_id % 2 = 1")).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count("*").alias("n"))


# Generators.


@query("gn4_label_ring", f"WITH {LABEL} SELECT node AS src, next AS dst FROM (SELECT node, lead(node) OVER (PARTITION BY label ORDER BY node) AS next FROM lab WHERE label IS NOT NULL) WHERE next IS NOT NULL")
def _(t):
    return GN.ordered_ring(t.labels_of_parts().where("label IS NOT NULL"))


@query("gn8_bipartite_popularity", f"WITH u AS (SELECT c_custkey AS src, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM part) AS items FROM customer), e AS (SELECT src, j, floor(items * pow({draw_sql("'gn8|' || src || '|' || j")} / 4294967296.0::DOUBLE, 2))::BIGINT + users AS dst FROM u, (VALUES (0), (1), (2)) AS x(j)) SELECT DISTINCT src, dst FROM e")
def _(t):
    """Every user takes three items whose popularity falls with their number; at least one edge each."""
    from ..functions.draws import uniform

    users = GN.nodes(t.spark, t.customer.count()).select(F.col("node").alias("src"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    return users.select("src", (F.floor(t.part.count() * F.pow(uniform("gn8|", F.col("src"), "|", F.col("j")), 2.0)) + t.customer.count()).alias("dst")).distinct()


@query("gn11_conditioned_graph", f"WITH RECURSIVE g AS (SELECT a.id AS u, b.id AS v FROM (SELECT p_partkey AS id FROM part) AS a, (SELECT p_partkey AS id FROM part) AS b WHERE a.id < b.id AND {draw_sql("'gn11|' || a.id || '|' || b.id")} / 4294967296.0::DOUBLE < CASE WHEN a.id % 3 = b.id % 3 THEN 6.0::DOUBLE ELSE 0.6::DOUBLE END / (SELECT count(*) FROM part)), e AS (SELECT u AS src, v AS dst FROM g UNION ALL SELECT v, u FROM g), r(node, root) AS (SELECT id, id FROM (SELECT p_partkey AS id FROM part) AS x UNION SELECT dst, root FROM r JOIN e ON src = node WHERE root < dst), c AS (SELECT node, min(root) AS root FROM r GROUP BY node), k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM c WHERE root = (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)) SELECT a.k AS src, b.k AS dst FROM e JOIN k a ON src = a.node JOIN k b ON dst = b.node")
def _(t):
    n = t.part.count()
    edges = G.symmetrise(GN.label_blocks(t.spark, n, 3, 6.0 / n, 0.6 / n, "gn11|"), loops=False)
    return G.induced_subgraph(edges, A.largest_component(GN.nodes(t.spark, n), edges))


@query("gn17_structural_table", f"WITH z AS (SELECT id AS node, {draw_sql("'gn17a|u|' || id")} / 4294967296.0::DOUBLE AS a, {draw_sql("'gn17b|u|' || id")} / 4294967296.0::DOUBLE AS b FROM (SELECT p_partkey AS id FROM part) AS r) SELECT node, round(a, 9) AS x1, round(exp(-(a + b) * (a + b)), 9) AS x2, (sin(3 * a) + b > 1)::INT AS y FROM z")
def _(t):
    """A table from a small causal graph: two roots, an activation over their sum, a thresholded label."""
    a, b = (GN.sampled(t.spark, t.part.count(), "uniform", s).withColumnRenamed("x", n) for s, n in (("gn17a|", "a"), ("gn17b|", "b")))
    z = a.join(b, "node")
    return z.select("node", F.round("a", 9).alias("x1"), F.round(X.ACTIVATIONS["rbf"](F.col("a") + F.col("b")), 9).alias("x2"), (X.ACTIVATIONS["sine"](3 * F.col("a")) + F.col("b") > 1).cast("int").alias("y"))


@query("m17_grid_labels", f"WITH c AS (SELECT id, id // 625 AS grid, {draw_sql("'m17|' || id")} % 2 AS y FROM (SELECT s_suppkey * 625 + j AS id FROM supplier, range(625) AS x(j)) AS r) SELECT grid, count(*) AS n, sum(y)::BIGINT AS pos FROM c GROUP BY grid")
def _(t):
    from ..functions.draws import draw

    cells = t.spark.range(625 * t.supplier.count()).select(F.floor(F.col("id") / 625).alias("grid"), (draw("m17|", F.col("id")) % 2).alias("y"))
    return cells.groupBy("grid").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@query("ag7_triangle_profile", f"WITH {PART}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND a.dst < b.dst), n AS (SELECT node, count(*) AS k FROM (SELECT unnest([x, y, z]) AS node FROM t) GROUP BY node), {LABEL} SELECT label, sum(k)::BIGINT AS triangles, count(*) AS nodes FROM n JOIN lab USING (node) WHERE label IS NOT NULL GROUP BY GROUPING SETS ((), (label))")
def _(t):
    met = ST.triangles_by_node(t.part_edges()).join(t.labels_of_parts().where("label IS NOT NULL"), "node")
    return met.rollup("label").agg(F.sum("triangles").alias("triangles"), F.count("*").alias("nodes"))
