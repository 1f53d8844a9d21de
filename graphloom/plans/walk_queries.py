"""Queries of walks, link scores, candidates, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, draw_sql, uniform
from ..operators import graph as G
from ..operators import links as L
from ..operators import ranking as R
from ..operators import splits as S
from ..operators import statistics as ST
from ..operators import walks as WK
from ..shared import written
from ..sources.fixtures import BIP, KG, LABEL, NEXT, PART, both_ways
from .registry import query

LENGTH = 6
ADJ = "adjl AS (SELECT src, list(dst ORDER BY dst) AS l, count(*) AS d FROM tedges GROUP BY src)"


def _walk_sql(seed: str, pick: str, again: str = "false") -> str:
    x = draw_sql(f"'{seed}|' || walk || '|' || (pos + 1)")
    return f"""WITH RECURSIVE {PART}, {ADJ},
w(walk, pos, start, node, prev, restart) AS (SELECT p_partkey, 0, p_partkey, p_partkey, NULL::BIGINT, false FROM part
  UNION ALL SELECT walk, pos + 1, start, CASE WHEN {again} THEN start WHEN d IS NULL THEN node ELSE ({pick.format(x=x)}) END,
    CASE WHEN {again} OR d IS NULL THEN NULL ELSE node END, {again} FROM w LEFT JOIN adjl ON src = node WHERE pos < {LENGTH})
"""


ANY = "l[{x} % d + 1]"
ONWARD = "CASE WHEN d = 1 OR prev IS NULL THEN l[{x} % d + 1] ELSE list_filter(l, lambda y: y <> prev)[{x} % greatest(d - 1, 1) + 1] END"
CHANCE = "(" + draw_sql("'rw4r|' || walk || '|' || (pos + 1)") + " / 4294967296.0::DOUBLE < 0.3 AND NOT restart)"


def _starts(t):
    return t.part_nodes().select(F.col("node").alias("walk_id"), "node")


def _rows(walks):
    return WK.positions(walks)


@query("rw3_uniform_walk", _walk_sql("rw3", ANY) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw3"))


@query("rw2_non_backtracking_walk", _walk_sql("rw2", ONWARD) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw2", backtrack=False))


@query("rw4_restart_walk", _walk_sql("rw4", ANY, CHANCE) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw4", restart=0.3))


@query("rw5_restart_non_backtracking", _walk_sql("rw4", ONWARD, CHANCE) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw4", backtrack=False, restart=0.3))


@query("rw6_periodic_restart", _walk_sql("rw6", ANY, "((pos + 1) % 3 = 0)") + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw6", period=3))


@query("rw7_periodic_non_backtracking", _walk_sql("rw7", ONWARD, "((pos + 1) % 3 = 0)") + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    return _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw7", backtrack=False, period=3))


MINDEG = "deg AS (SELECT src AS node, count(*) AS d FROM tedges GROUP BY src), wt AS (SELECT src, dst, 1 / greatest(least(a.d, b.d), 1)::DOUBLE AS w FROM tedges JOIN deg a ON src = a.node JOIN deg b ON dst = b.node)"


@query("rw12_minimum_degree_weights", f"WITH {PART}, {MINDEG} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM wt")
def _(t):
    w = S_min_degree(t.part_edges("train"))
    return w.select("src", "dst", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("src")), 9).alias("p"))


def S_min_degree(edges):
    d = L.node_degrees(edges)
    met = edges.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    return met.select("src", "dst", (L.ONE / F.greatest(F.least("ds", "dd"), F.lit(1))).alias("w"))


@query(
    "rw1_weighted_walk",
    f"""WITH RECURSIVE {PART}, {MINDEG},
c AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) / sum(w) OVER (PARTITION BY src) AS hi, row_number() OVER (PARTITION BY src ORDER BY dst DESC) = 1 AS final FROM wt),
b AS (SELECT src, dst, coalesce(lag(hi) OVER (PARTITION BY src ORDER BY dst), 0) AS lo, CASE WHEN final THEN 2 ELSE hi END AS hi FROM c),
w(walk, pos, node) AS (SELECT p_partkey, 0, p_partkey FROM part UNION ALL SELECT walk, pos + 1, coalesce(dst, node) FROM
  (SELECT *, {draw_sql("'rw1|' || walk || '|' || (pos + 1)")} / 4294967296.0::DOUBLE AS x FROM w WHERE pos < 4) LEFT JOIN b ON node = src AND x >= lo AND x < hi)
SELECT walk AS walk_id, pos, node FROM w""",
)
def _(t):
    return _rows(WK.weighted_walk(_starts(t), S_min_degree(t.part_edges("train")), 4, "rw1"))


@query(
    "rw8_node2vec_walk",
    f"""WITH RECURSIVE {PART},
w(walk, pos, node, prev) AS (SELECT p_partkey, 0, p_partkey, NULL::BIGINT FROM part UNION ALL
  SELECT walk, pos + 1, coalesce(dst, node), node FROM (
    SELECT *, row_number() OVER (PARTITION BY walk ORDER BY dst) AS k FROM (
      SELECT *, sum(wt) OVER (PARTITION BY walk ORDER BY dst) AS hi, sum(wt) OVER (PARTITION BY walk) AS total, row_number() OVER (PARTITION BY walk ORDER BY dst DESC) = 1 AS last FROM (
        SELECT w.*, e.dst, {draw_sql("'rw8|' || walk || '|' || (pos + 1)")} / 4294967296.0::DOUBLE AS x, CASE WHEN prev IS NULL OR n.src IS NOT NULL THEN 1 WHEN e.dst = prev THEN 2.0 ELSE 0.5 END::DOUBLE AS wt
        FROM w LEFT JOIN tedges e ON e.src = node LEFT JOIN tedges n ON n.src = prev AND n.dst = e.dst WHERE pos < 3)) WHERE round(hi, 9) > round(x * total, 9) OR last) WHERE k = 1)
SELECT walk AS walk_id, pos, node FROM w""",
)
def _(t):
    return _rows(WK.second_order_walk(_starts(t), t.part_edges("train"), 3, "rw8", 0.5, 2.0))


@query("rw13_stationary", f"WITH {PART} SELECT src AS node, round(count(*) / sum(count(*)) OVER (), 12) AS p FROM tedges GROUP BY src")
def _(t):
    d = L.node_degrees(t.part_edges("train"))
    total = d.agg(F.sum("d").alias("total"))  # one row
    return d.crossJoin(F.broadcast(total)).select("node", F.round(F.col("d") / F.greatest("total", F.lit(1)), 12).alias("p"))


@query("rw11_subsampled_transitions", f"WITH {PART}, deg AS (SELECT src AS node, count(*) AS d FROM tedges GROUP BY src), wt AS (SELECT src, dst, 1 / sqrt(d + 1.0::DOUBLE) AS w FROM tedges JOIN deg ON dst = node) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM wt")
def _(t):
    edges = t.part_edges("train")
    met = edges.join(L.node_degrees(edges).toDF("dst", "d"), "dst").withColumn("w", L.ONE / F.sqrt(F.col("d") + L.ONE))
    return met.select("src", "dst", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("src")), 9).alias("p"))


@query("w4_anonymised_walk", _walk_sql("rw2", ONWARD) + ", f AS (SELECT walk, node, min(pos) AS first FROM w GROUP BY walk, node), r AS (SELECT walk, node, dense_rank() OVER (PARTITION BY walk ORDER BY first) AS anon FROM f) SELECT walk AS walk_id, string_agg(anon::VARCHAR, '-' ORDER BY pos) AS anon FROM w JOIN r USING (walk, node) GROUP BY walk")
def _(t):
    walks = WK.anonymised(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw2", backtrack=False))
    return walks.select("walk_id", WK.as_text(F.col("anon")).alias("anon"))


@query("rw15_walk_text", _walk_sql("rw4", ANY, CHANCE) + "SELECT walk AS walk_id, substr(string_agg((CASE WHEN restart THEN ';' ELSE '-' END) || node, '' ORDER BY pos), 2) AS text FROM w GROUP BY walk")
def _(t):
    walks = WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw4", restart=0.3)
    return walks.select("walk_id", WK.as_text(F.col("path"), F.col("restarts")).alias("text"))


@query("w6_previous_node", _walk_sql("rw4", ANY, CHANCE) + "SELECT walk AS walk_id, pos, CASE WHEN NOT restart THEN lag(node) OVER (PARTITION BY walk ORDER BY pos) END AS prev FROM w")
def _(t):
    rows = _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw4", restart=0.3))
    return rows.select("walk_id", "pos", F.when(~F.col("restart"), F.lag("node").over(Window.partitionBy("walk_id").orderBy("pos"))).alias("prev"))


KGW = f"""WITH RECURSIVE {KG}, sides AS (SELECT h AS src, t AS dst FROM kg WHERE split = 'train' UNION SELECT t, h FROM kg WHERE split = 'train'),
adjl AS (SELECT src, list(dst ORDER BY dst) AS l, count(*) AS d FROM sides GROUP BY src),
w(walk, pos, node) AS (SELECT p_partkey, 0, p_partkey FROM part UNION ALL SELECT walk, pos + 1, coalesce(l[{draw_sql("'j2|' || walk || '|' || (pos + 1)")} % d + 1], node) FROM w LEFT JOIN adjl ON src = node WHERE pos < 4),
m AS (SELECT walk, pos, node, lag(node) OVER (PARTITION BY walk ORDER BY pos) AS prev FROM w),
e AS (SELECT h AS a, t AS b, r, 0 AS dir FROM kg WHERE split = 'train' UNION ALL SELECT t, h, r, 1 FROM kg WHERE split = 'train')
"""


def _kg_walk(t):
    train = t.triples().where("split = 'train'")
    edges = G.symmetrise(train.select(F.col("h").alias("src"), F.col("t").alias("dst")))
    return train, _rows(WK.walk(_starts(t), edges, 4, "j2")).drop("restart")


@query("j2_step_types", KGW + f"SELECT walk AS walk_id, pos, r AS rel, dir FROM (SELECT walk, pos, r, dir, row_number() OVER (PARTITION BY walk, pos ORDER BY {draw_sql("'j2t|' || walk || '|' || pos || '|' || coalesce(r, -1) || '|' || coalesce(dir, -1)")}, r, dir) AS k FROM m LEFT JOIN e ON prev = a AND node = b) WHERE k = 1")
def _(t):
    train, places = _kg_walk(t)
    return WK.step_types(places, train, "j2t")


@query("rw16_forward_types_only", KGW + f"SELECT walk AS walk_id, pos, r AS rel, dir FROM (SELECT walk, pos, r, dir, row_number() OVER (PARTITION BY walk, pos ORDER BY {draw_sql("'rw16|' || walk || '|' || pos || '|' || coalesce(r, -1) || '|' || coalesce(dir, -1)")}, r, dir) AS k FROM m LEFT JOIN (SELECT * FROM e WHERE dir <> 1) f ON prev = a AND node = b) WHERE k = 1")
def _(t):
    train, places = _kg_walk(t)
    return WK.step_types(places, train, "rw16", only_forward=True)


@query("j4_backward_steps", KGW + "SELECT walk AS walk_id, pos, prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kg WHERE split = 'train' AND h = prev AND t = node) AS backwards FROM m")
def _(t):
    train, places = _kg_walk(t)
    moves = places.withColumn("prev", F.lag("node").over(Window.partitionBy("walk_id").orderBy("pos")))
    there = train.select(F.col("h").alias("prev"), F.col("t").alias("node"), F.lit(True).alias("there")).distinct()
    return moves.join(there, ["prev", "node"], "left").select("walk_id", "pos", (F.col("prev").isNotNull() & F.col("there").isNull()).alias("backwards"))


@query("rw10_prefix_resume", _walk_sql("rw2", ONWARD) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    """Walks of two steps (one for every third), stored and gone on with: the rows of walks that were never cut."""
    edges = t.part_edges("train")
    begun = WK.walk(_starts(t), edges, 2, "rw2", backtrack=False)
    prefixes = begun.select("walk_id", F.when(F.col("walk_id") % 3 == 0, F.slice("path", 1, 2)).otherwise(F.col("path")).alias("path"))
    return _rows(WK.walk(written(prefixes, "prefixes"), edges, LENGTH, "rw2", backtrack=False))


@query("rw9_dispatch", _walk_sql("rw4", ONWARD, CHANCE) + "SELECT walk AS walk_id, pos, node, restart FROM w")
def _(t):
    """The dispatcher picks the way to walk by its arguments: here restarts by chance, without backtracking."""
    return _rows(WK.random_walks(_starts(t), t.part_edges("train"), LENGTH, "rw4", backtrack=False, restart=0.3))


@query("rw18_balanced_starts", f"WITH {KG}, o AS (SELECT h, r, t, row_number() OVER (PARTITION BY r ORDER BY {draw_sql("'w10' || h || '|' || t || '|' || r")}, h, t) - 1 AS k, count(*) OVER (PARTITION BY r) AS n FROM kg WHERE split = 'test') SELECT r AS rel, j, h AS src, t AS dst FROM o, unnest(range(0, 300)) AS u(j) WHERE k = j % n")
def _(t):
    some = t.triples().where("split = 'test'").select(F.col("h").alias("src"), F.col("t").alias("dst"), F.col("r").alias("rel"))
    return WK.balanced_starts(some, 300, "w10")


@query("rw20_walk_budget", "SELECT 'part' AS graph, CASE WHEN n <= 1000 THEN 32 WHEN n <= 10000 THEN 64 WHEN n <= 40000 THEN 128 ELSE 256 END AS walks, CASE WHEN n <= 1000 THEN 32 ELSE 128 END AS steps FROM (SELECT count(*) AS n FROM part)")
def _(t):
    return t.part.agg(F.count("*").alias("n")).select(F.lit("part").alias("graph"), WK.budget(F.col("n")).alias("b")).select("graph", "b.walks", "b.steps")


@query("rw21_joined_walks", _walk_sql("rw3", ANY) + "SELECT walk // 2 AS walk_id, (walk % 2) * 7 + pos AS pos, node, pos = 0 AND walk % 2 = 1 AS restart FROM w")
def _(t):
    rows = _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw3"))
    later = F.col("walk_id") % 2 == 1
    return rows.select(F.floor(F.col("walk_id") / 2).alias("walk_id"), ((F.col("walk_id") % 2) * (LENGTH + 1) + F.col("pos")).alias("pos"), "node", ((F.col("pos") == 0) & later).alias("restart"))


@query("rw22_coverage", _walk_sql("rw3", ANY) + "SELECT count(DISTINCT node) FILTER (WHERE pos > 0) AS visited, count(DISTINCT node) FILTER (WHERE pos = 0) AS starts, round(count(DISTINCT node) FILTER (WHERE pos > 0) / (SELECT count(*) FROM part)::DOUBLE, 9) AS share FROM w")
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    rows = _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw3"))
    seen = rows.agg(F.countDistinct(F.when(F.col("pos") > 0, F.col("node"))).alias("visited"), F.countDistinct(F.when(F.col("pos") == 0, F.col("node"))).alias("starts"))
    return seen.crossJoin(n).select("visited", "starts", F.round(F.col("visited") / F.col("n"), 9).alias("share"))


@query("ag18_visits", _walk_sql("rw3", ANY) + f", {LABEL} SELECT node, count(DISTINCT walk) AS walks, count(DISTINCT walk) FILTER (WHERE hit) AS hits FROM (SELECT w.walk, w.node, bool_or(part = 'train') OVER (PARTITION BY walk) AS hit FROM w JOIN nsplit ON nsplit.node = w.node) GROUP BY node")
def _(t):
    rows = _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw3")).join(t.split_of_parts(), "node")
    hit = F.max(F.col("part") == "train").over(Window.partitionBy("walk_id"))
    return rows.withColumn("hit", hit).groupBy("node").agg(F.countDistinct("walk_id").alias("walks"), F.countDistinct(F.when(F.col("hit"), F.col("walk_id"))).alias("hits"))


@query("pf12_train_hitting_walks", _walk_sql("rw3", ANY) + f", {LABEL}, k AS (SELECT walk, bool_or(part = 'train') AS hit FROM w JOIN nsplit ON nsplit.node = w.node GROUP BY walk) SELECT walk AS walk_id, hit FROM k WHERE hit OR {draw_sql("'pf12|' || walk")} / 4294967296.0::DOUBLE < 0.25 OR walk = 0")
def _(t):
    rows = _rows(WK.walk(_starts(t), t.part_edges("train"), LENGTH, "rw3")).join(t.split_of_parts(), "node")
    hits = rows.groupBy("walk_id").agg(F.bool_or(F.col("part") == "train").alias("hit"))
    return hits.where(F.col("hit") | (uniform("pf12|", F.col("walk_id")) < 0.25) | (F.col("walk_id") == 0))


# Links.

CN = "c AS (SELECT a.src, b.dst AS cand, count(*) AS cn, sum(1.0::DOUBLE / d.d) AS ra FROM tedges a JOIN tedges b ON a.dst = b.src JOIN (SELECT src, count(*) AS d FROM tedges GROUP BY src) d ON d.src = b.src WHERE a.src <> b.dst GROUP BY a.src, b.dst)"


@query("l2_l3_wedge_scores", f"WITH {PART}, {CN} SELECT src, cand, cn, round(ra, 7) AS ra FROM c")
def _(t):
    return L.wedge_scores(t.part_edges("train")).withColumn("ra", F.round("ra", 7))


@query("l4_l6_pair_scores", f"WITH {PART}, {CN}, deg AS (SELECT src AS node, count(*) AS d FROM tedges GROUP BY src) SELECT x.src, x.dst, coalesce(cn, 0) AS cn, round(coalesce(ra, 0), 7) AS ra, coalesce(a.d, 0) * coalesce(b.d, 0) AS pa FROM (SELECT u AS src, v AS dst FROM pairs WHERE split = 'test') x LEFT JOIN c ON c.src = x.src AND c.cand = x.dst LEFT JOIN deg a ON a.node = x.src LEFT JOIN deg b ON b.node = x.dst")
def _(t):
    pairs = t.part_pairs().where("split = 'test'").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return L.pair_scores(pairs, t.part_edges("train")).withColumn("ra", F.round("ra", 7))


def _recall_sql(by: str) -> str:
    return f"""WITH {PART}, {CN}, deg AS (SELECT src AS node, count(*) AS d FROM tedges GROUP BY src),
f AS (SELECT c.* FROM c WHERE src IN (SELECT src FROM xedges) AND NOT EXISTS (SELECT 1 FROM tedges t WHERE t.src = c.src AND t.dst = c.cand)),
r AS (SELECT src, cand, row_number() OVER (PARTITION BY src ORDER BY round({by}, 9) DESC, d DESC, cand) AS rank FROM f JOIN deg ON node = cand),
n AS (SELECT src, count(*) AS n FROM xedges GROUP BY src), i AS (SELECT src, n, (SELECT sum(1 / log2(k + 1.0::DOUBLE)) FROM unnest(range(1, least(n, 20) + 1)) AS u(k)) AS ideal FROM n),
h AS (SELECT r.src, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM r JOIN xedges x ON x.src = r.src AND x.dst = r.cand WHERE rank <= 20 GROUP BY r.src)
SELECT count(*) AS sources, round(avg(coalesce(h, 0) / n::DOUBLE), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, sum(coalesce(h, 0))::BIGINT AS hits, sum(n)::BIGINT AS pairs, round(sum(coalesce(dcg, 0)), 6) AS dcg FROM i LEFT JOIN h USING (src)"""


def _recall(t, by):
    pairs = written(t.part_pairs(), "pairs")  # read six times below
    train, test = (both_ways(pairs.where(f"split = '{s}'")) for s in ("train", "test"))
    scores = L.wedge_scores(train, test.select("src").distinct(), known=train)
    return R.recall_at_k(L.ranked_candidates(scores, train, by, 20), test.select("src", F.col("dst").alias("cand")), 20)


@query("m5_heuristic_recall_ra", _recall_sql("ra"))
def _(t):
    return _recall(t, "ra")


@query("m5_heuristic_recall_cn", _recall_sql("cn"))
def _(t):
    return _recall(t, "cn")


@query("j9_shared_neighbours", f"WITH {PART} SELECT a.src, c.dst, count(*) AS shared FROM edges c JOIN edges a ON a.src = c.src JOIN edges b ON b.src = c.dst AND a.dst = b.dst WHERE c.src < c.dst GROUP BY a.src, c.dst")
def _(t):
    edges = written(t.part_edges(), "edges")
    return L.pair_scores(edges.where("src < dst"), edges).where("cn > 0").select("src", "dst", F.col("cn").alias("shared"))


@query("l16_candidate_pool", f"WITH {PART}, n AS (SELECT count(*) AS n FROM part) SELECT round(avg(greatest(0, n.n - 1 - coalesce(d, 0))), 6) AS pool FROM (SELECT DISTINCT src FROM xedges) s LEFT JOIN (SELECT src, count(*) AS d FROM tedges GROUP BY src) t ON t.src = s.src, n")
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    known = L.node_degrees(t.part_edges("train")).toDF("src", "d")
    met = t.part_edges("test").select("src").distinct().join(known, "src", "left").crossJoin(F.broadcast(n))
    return met.agg(F.round(F.avg(F.greatest(F.lit(0), F.col("n") - 1 - F.coalesce("d", F.lit(0)))), 6).alias("pool"))


POOL = "SELECT s_suppkey + (SELECT count(*) FROM part) AS node FROM supplier"


@query(
    "j6_l11_negatives",
    f"""WITH {KG}, pool AS ({POOL}), num AS (SELECT node AS t, row_number() OVER (ORDER BY {draw_sql("'l11|' || node")}, node) - 1 AS i FROM pool), m AS (SELECT count(*) AS m FROM pool),
pos AS (SELECT h, r, t FROM kg WHERE split = 'train'), hr AS (SELECT h, r, count(*) AS n FROM pos GROUP BY h, r),
tries AS (SELECT h, r, j, ({draw_sql("'l11|' || h || '|' || r")} % m + j) % m AS i FROM hr, m, unnest(range(0, least(n + 5, m))) AS u(j)),
free AS (SELECT h, r, j, t FROM tries JOIN num USING (i) ANTI JOIN pos USING (h, r, t))
SELECT h, r, t, nth FROM (SELECT h, r, t, row_number() OVER (PARTITION BY h, r ORDER BY j) AS nth FROM free) WHERE nth <= 5""",
)
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    pool = t.supplier.crossJoin(F.broadcast(n)).select((F.col("s_suppkey") + F.col("n")).alias("node"))
    return L.negatives(t.triples().where("split = 'train'"), pool, 5, "l11|")


@query("l12_corrupted_tails", f"WITH {KG}, x AS (SELECT h, r, t, (SELECT count(*) FROM part) AS o, (SELECT count(*) FROM supplier) AS n FROM kg WHERE split = 'test'), y AS (SELECT *, {draw_sql("'l12|' || h || '|' || r || '|' || t")} % (n - 1) + o AS c FROM x) SELECT h, r, t, c + CASE WHEN c >= t THEN 1 ELSE 0 END AS neg FROM y")
def _(t):
    n_parts, n_suppliers = t.part.count(), t.supplier.count()
    return L.corrupted_tails(t.triples().where("split = 'test'"), n_suppliers, n_parts, "l12|")


CANDIDATES = f"""taken AS (SELECT src, dst FROM tedges UNION SELECT src, dst FROM xedges), n AS (SELECT count(*) AS n FROM part),
num AS (SELECT p_partkey AS dst, row_number() OVER (ORDER BY {draw_sql("'l13|' || p_partkey")}, p_partkey) - 1 AS i FROM part),
d AS (SELECT src, count(*) AS d FROM taken WHERE src IN (SELECT src FROM xedges) GROUP BY src),
tries AS (SELECT src, j, ({draw_sql("'l13|' || src")} + j) % n AS i FROM d, n, unnest(range(0, least(d + 20, n - 1) + 1)) AS u(j)),
free AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY j) AS nth FROM tries JOIN num USING (i) ANTI JOIN taken USING (src, dst) WHERE src <> dst),
lists AS (SELECT DISTINCT src, dst AS cand, true AS is_pos FROM xedges UNION ALL SELECT src, dst, false FROM free WHERE nth <= 20)"""


@query("l13_candidate_lists", f"WITH {PART}, {CANDIDATES} SELECT src, cand, is_pos FROM lists")
def _(t):
    return L.candidate_lists(t.part_edges("train"), t.part_edges("test"), t.part_nodes(), 20, "l13|")


@query("l14_candidate_slices", f"WITH {PART}, {CANDIDATES} SELECT src, string_agg(cand::VARCHAR, ',' ORDER BY cand) FILTER (WHERE is_pos) AS pos, count(*) FILTER (WHERE NOT is_pos) AS n_neg FROM lists WHERE {draw_sql("'l14|' || src")} % 3 = 0 GROUP BY src")
def _(t):
    lists = L.candidate_lists(t.part_edges("train"), t.part_edges("test"), t.part_nodes(), 20, "l13|")
    kept = lists.where(draw("l14|", F.col("src")) % 3 == 0).groupBy("src")
    return kept.agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("is_pos"), F.col("cand")))), ",").alias("pos"), F.count_if(~F.col("is_pos")).alias("n_neg"))


@query(
    "m6_sampled_recall",
    f"""WITH {PART}, {CANDIDATES}, {CN}, s AS (SELECT l.src, l.cand, is_pos, coalesce(ra, 0) AS ra FROM lists l LEFT JOIN c ON c.src = l.src AND c.cand = l.cand),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(ra, 9) DESC, cand) AS rank FROM s),
n0 AS (SELECT src, count(*) AS n FROM lists WHERE is_pos GROUP BY src), nn AS (SELECT src, n, (SELECT sum(1 / log2(k + 1.0::DOUBLE)) FROM unnest(range(1, least(n, 20) + 1)) AS u(k)) AS ideal FROM n0),
h AS (SELECT src, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM r WHERE rank <= 20 AND is_pos GROUP BY src)
SELECT count(*) AS sources, round(avg(coalesce(h, 0) / n::DOUBLE), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, sum(coalesce(h, 0))::BIGINT AS hits, sum(n)::BIGINT AS pairs, round(sum(coalesce(dcg, 0)), 6) AS dcg FROM nn LEFT JOIN h USING (src)""",
)
def _(t):
    train, test = t.part_edges("train"), t.part_edges("test")
    lists = L.candidate_lists(train, test, t.part_nodes(), 20, "l13|")
    lists = written(lists, "lists")
    scored = lists.join(L.pair_scores(lists.select("src", F.col("cand").alias("dst")), train).withColumnRenamed("dst", "cand"), ["src", "cand"])
    order = Window.partitionBy("src").orderBy(F.desc(F.round("ra", 9)), "cand")
    ranked = scored.select("src", "cand", "is_pos", F.row_number().over(order).alias("rank"))
    return R.recall_at_k(ranked, lists.where("is_pos").select("src", "cand"), 20)


# Ranking.

SCORES = f"""q AS (SELECT h || ':' || r || ':' || t AS qid, h, r, t FROM kg WHERE split = 'test'), cand AS ({POOL}),
s AS (SELECT qid, h, r, t, node AS cand, {draw_sql("qid || ':' || node")} % 1000 AS score FROM q, cand),
tr AS (SELECT qid, score AS ts FROM s WHERE cand = t),
ranks AS (SELECT s.qid, any_value(s.r) AS r, any_value(s.t) AS cand, 1 + count(*) FILTER (WHERE s.cand <> s.t AND s.score >= ts AND k.t IS NULL) AS pess, 1 + count(*) FILTER (WHERE s.cand <> s.t AND s.score > ts AND k.t IS NULL) AS opt
  FROM s JOIN tr USING (qid) LEFT JOIN kg k ON k.h = s.h AND k.r = s.r AND k.t = s.cand GROUP BY s.qid)"""


def _queries(t):
    """Test triples as queries ``qid, r, truth, known``, and every supplier as a candidate."""
    n = t.part.agg(F.count("*").alias("n"))  # one row
    cand = t.supplier.crossJoin(F.broadcast(n)).select((F.col("s_suppkey") + F.col("n")).alias("cand"))
    tails = t.triples().groupBy("h", "r").agg(F.collect_list(F.struct("t", "split")).alias("tails"))
    asked = tails.select("h", "r", "tails.t", F.explode(F.expr("filter(tails, x -> x.split = 'test')")).alias("q"))
    return asked.select(F.concat_ws(":", "h", "r", "q.t").alias("qid"), "r", F.col("q.t").alias("truth"), F.col("t").alias("known")), cand


def _score(cand):
    """A synthetic score of a query and a candidate."""
    return draw(F.col("qid"), ":", cand) % 1000


def _ranks(t, ties="pessimistic"):
    found = R.full_ranks(*_queries(t), _score)
    return found.select("qid", "r", F.col("truth").alias("cand"), (F.col("at" if ties == "pessimistic" else "above") + 1).alias("rank"))


for _ties, _col in (("pessimistic", "pess"), ("optimistic", "opt")):

    @query(f"{'w1_pessimistic' if _col == 'pess' else 'w2_optimistic'}_ranks", f"WITH {KG}, {SCORES} SELECT qid, cand, {_col} AS rank FROM ranks")
    def _(t, ties=_ties):
        return _ranks(t, ties).drop("r")


@query("m1_m2_filtered_mrr", f"WITH {KG}, {SCORES} SELECT r, round(avg(1.0::DOUBLE / pess), 9) AS mrr, round(avg((pess <= 1)::INT), 9) AS hits_1, round(avg((pess <= 3)::INT), 9) AS hits_3, round(avg((pess <= 10)::INT), 9) AS hits_10, count(*) AS n_queries FROM ranks GROUP BY GROUPING SETS ((), (r))")
def _(t):
    return R.rank_metrics(_ranks(t), "r")


@query("m3_baseline_mrr", f"WITH {KG}, {SCORES} SELECT round(avg(1.0::DOUBLE / opt), 9) AS mrr, round(avg((opt <= 1)::INT), 9) AS hits_1, round(avg((opt <= 3)::INT), 9) AS hits_3, round(avg((opt <= 10)::INT), 9) AS hits_10, count(*) AS n_queries FROM ranks")
def _(t):
    return R.rank_metrics(_ranks(t, "optimistic"))


@query("w3_top_k", f"WITH {KG}, {SCORES} SELECT qid, cand, rank FROM (SELECT qid, cand, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS rank FROM s) WHERE rank <= 10")
def _(t):
    queries, cand = _queries(t)
    return R.top_candidates(queries.select("qid"), cand, _score, 10)


@query(
    "m4_full_pool_recall",
    f"""WITH {KG}, hr AS (SELECT DISTINCT h, r FROM kg WHERE split = 'test'), cand AS ({POOL}), s AS (SELECT h || ':' || r AS src, node AS cand, {draw_sql("h || ':' || r || ':' || node")} AS score FROM (SELECT h, r, node FROM hr, cand) ANTI JOIN (SELECT h, r, t AS node FROM kg WHERE split = 'train') x USING (h, r, node)),
rk AS (SELECT src, cand, row_number() OVER (PARTITION BY src ORDER BY score DESC, cand) AS rank FROM s), tg AS (SELECT h || ':' || r AS src, t AS cand FROM kg WHERE split = 'test'),
n0 AS (SELECT src, count(*) AS n FROM tg GROUP BY src), n AS (SELECT src, n, (SELECT sum(1 / log2(k + 1.0::DOUBLE)) FROM unnest(range(1, least(n, 20) + 1)) AS u(k)) AS ideal FROM n0),
h AS (SELECT rk.src, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM rk JOIN tg ON tg.src = rk.src AND tg.cand = rk.cand WHERE rank <= 20 GROUP BY rk.src)
SELECT count(*) AS sources, round(avg(coalesce(h, 0) / n::DOUBLE), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, sum(coalesce(h, 0))::BIGINT AS hits, sum(n)::BIGINT AS pairs, round(sum(coalesce(dcg, 0)), 6) AS dcg FROM n LEFT JOIN h USING (src)""",
)
def _(t):
    n = t.part.agg(F.count("*").alias("n"))  # one row
    cand = t.supplier.crossJoin(F.broadcast(n)).select((F.col("s_suppkey") + F.col("n")).alias("cand"))
    by_source = t.triples().groupBy("h", "r").agg(*[F.collect_list(F.when(F.col("split") == s, F.col("t"))).alias(s) for s in ("train", "test")]).where("size(test) > 0")
    sources = by_source.select(F.concat_ws(":", "h", "r").alias("src"), "train", "test")
    ranked = R.top_candidates(sources.select("src", "train"), cand, lambda c: draw(F.col("src"), ":", c), 20, known="train")
    return R.recall_at_k(ranked, sources.select("src", F.explode("test").alias("cand")), 20)


CLASSES = f"{LABEL}, cs AS (SELECT node, k AS label, {draw_sql("'cs|' || node || '|' || k")} % 500 AS score FROM lab, (SELECT k FROM types) WHERE lab.label IS NOT NULL)"


def _class_scores(t):
    labels = t.labels_of_parts().where("label IS NOT NULL")
    classes = labels.select("label").distinct()  # the class domain
    return labels, labels.select("node").crossJoin(F.broadcast(classes)).select("node", "label", (draw("cs|", F.col("node"), "|", F.col("label")) % 500).alias("score"))


@query("m7_accuracy", f"WITH {CLASSES}, b AS (SELECT node, label AS best, row_number() OVER (PARTITION BY node ORDER BY score DESC, label) AS k FROM cs) SELECT round(avg((best = label)::INT), 9) AS accuracy, count(*) AS n FROM b JOIN lab USING (node) WHERE k = 1")
def _(t):
    labels, scores = _class_scores(t)
    return R.accuracy(scores, labels)


AUC = "rk AS (SELECT cs.label, cs.label = lab.label AS pos, rank() OVER (PARTITION BY cs.label ORDER BY score) + (count(*) OVER (PARTITION BY cs.label, score) - 1) / 2.0 AS r FROM cs JOIN lab USING (node)), a AS (SELECT label, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 9) AS auc FROM rk GROUP BY label)"


@query("m8_w15_class_auc", f"WITH {CLASSES}, {AUC} SELECT label, auc FROM a")
def _(t):
    labels, scores = _class_scores(t)
    return R.one_vs_rest_auc(scores, labels)


@query("m9_macro_auc", f"WITH {CLASSES}, {AUC} SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS classes FROM a")
def _(t):
    labels, scores = _class_scores(t)
    return R.one_vs_rest_auc(scores, labels).agg(F.round(F.avg("auc"), 6).alias("macro_auc"), F.count("auc").alias("classes"))


@query("m10_losses", f"WITH {CLASSES}, x AS (SELECT node, label, score / 100.0::DOUBLE AS z FROM cs), p AS (SELECT node, label, z, ln(sum(exp(z)) OVER (PARTITION BY node)) AS lse FROM x) SELECT round(avg(lse - z), 6) AS cross_entropy, round(avg(ln(1 + exp(-z))), 6) AS bce FROM p JOIN lab USING (node, label)")
def _(t):
    labels, scores = _class_scores(t)
    z = scores.withColumn("z", F.col("score") / 100.0).withColumn("lse", F.log(F.sum(F.exp("z")).over(Window.partitionBy("node"))))
    return z.join(labels, ["node", "label"]).agg(F.round(F.avg(F.col("lse") - F.col("z")), 6).alias("cross_entropy"), F.round(F.avg(F.log1p(F.exp(-F.col("z")))), 6).alias("bce"))


@query("m18_true_probability", f"WITH {CLASSES}, x AS (SELECT node, label, exp(score / 100.0::DOUBLE) AS e FROM cs), p AS (SELECT node, label, e / sum(e) OVER (PARTITION BY node) AS p FROM x) SELECT node, round(p, 9) AS p_true FROM p JOIN lab USING (node, label)")
def _(t):
    labels, scores = _class_scores(t)
    e = scores.withColumn("e", F.exp(F.col("score") / 100.0))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("node")))
    return p.join(labels, ["node", "label"]).select("node", F.round("p", 9).alias("p_true"))


# Statistics.


@query("m11_class_balance", f"WITH {LABEL}, n AS (SELECT count(*) / sum(count(*)) OVER () AS p, count(*) OVER () AS c FROM lab WHERE label IS NOT NULL GROUP BY label) SELECT round(-sum(p * log2(p)) / log2(max(c)), 9) AS class_balance FROM n")
def _(t):
    return ST.class_balance(t.labels_of_parts())


@query("m12_homophily", f"WITH {PART}, {LABEL}, e AS (SELECT least(a.label, b.label) AS x, greatest(a.label, b.label) AS y FROM edges JOIN lab a ON src = a.node JOIN lab b ON dst = b.node WHERE src <= dst AND a.label IS NOT NULL AND b.label IS NOT NULL), p AS (SELECT x, count(*) / (SELECT count(*) FROM e)::DOUBLE AS p FROM e WHERE x = y GROUP BY x), s AS (SELECT sum(sqrt(p)) AS s, sum(p) AS c FROM p) SELECT round((SELECT avg((x = y)::INT) FROM e), 9) AS edge_homophily, (SELECT count(*) FROM e) AS edges, round((s * s - 1) / (s * s + 1 - 2 * c), 9) AS unbiased_homophily FROM s")
def _(t):
    return ST.homophily(t.part_edges(), t.labels_of_parts())


@query("m13_feature_statistics", "SELECT round(var_samp(x), 9) AS variance, round(avg((x = 0)::INT), 9) AS sparsity FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def _(t):
    return ST.vector_statistics(t.embeddings, "embedding")


@query("m14_split_shares", f"WITH {PART}, {LABEL} SELECT 'nodes' AS what, round(avg((part = 'train')::INT), 9) AS train, round(avg((part = 'val')::INT), 9) AS val, round(avg((part = 'test')::INT), 9) AS test FROM nsplit UNION ALL SELECT 'edges', round(avg((split = 'train')::INT), 9), round(avg((split = 'val')::INT), 9), round(avg((split = 'test')::INT), 9) FROM pairs")
def _(t):
    def shares(df, col, what):
        return df.agg(*[F.round(F.avg((F.col(col) == p).cast("double")), 9).alias(p) for p in ("train", "val", "test")]).select(F.lit(what).alias("what"), "train", "val", "test")

    return shares(t.split_of_parts(), "part", "nodes").unionByName(shares(t.part_pairs(), "split", "edges"))


@query("m15_bipartite_statistics", f"WITH {BIP} SELECT count(DISTINCT src) AS users, count(DISTINCT dst) AS items, count(*) AS edges, round(count(*) / (count(DISTINCT src) * count(DISTINCT dst))::DOUBLE, 9) AS density FROM bip")
def _(t):
    return ST.bipartite_statistics(t.purchases())


@query("ag16_relation_statistics", f"WITH {KG} SELECT r, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM kg GROUP BY r")
def _(t):
    return ST.relation_statistics(t.triples())


TRI = "tri AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND a.dst < b.dst)"


@query("it9_triangles", f"WITH {PART}, {TRI} SELECT node, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM tri) GROUP BY node")
def _(t):
    return ST.triangles_by_node(t.part_edges())


@query("it5_clustering", f"WITH {PART}, {TRI}, n AS (SELECT node, count(*) AS k FROM (SELECT unnest([x, y, z]) AS node FROM tri) GROUP BY node), d AS (SELECT src AS node, count(*) AS d FROM edges GROUP BY src) SELECT round(avg(CASE WHEN d > 1 THEN 2 * coalesce(k, 0) / (d * (d - 1))::DOUBLE ELSE 0 END), 9) AS avg_clustering, (SELECT count(*) FROM tri) AS triangles FROM part LEFT JOIN d ON d.node = p_partkey LEFT JOIN n ON n.node = p_partkey")
def _(t):
    return ST.clustering(t.part_nodes(), t.part_edges())


@query("it9_four_cycles", f"WITH {PART}, c AS (SELECT a.src, b.dst AS cand, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.src, b.dst) SELECT DISTINCT src AS node FROM c WHERE n > 1")
def _(t):
    return ST.cycle_members(t.part_edges(), 4)


@query("it9_five_cycles", f"WITH {NEXT}, c AS (SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3, d.dst AS n4 FROM tedges a JOIN tedges b ON a.dst = b.src JOIN tedges c ON b.dst = c.src JOIN tedges d ON c.dst = d.src JOIN tedges e ON d.dst = e.src AND e.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.src < d.dst AND a.dst < d.dst AND b.dst <> d.dst AND a.dst <> c.dst) SELECT DISTINCT unnest([n0, n1, n2, n3, n4]) AS node FROM c")
def _(t):
    return ST.cycle_members(t.next_edges("train"), 5)


@query("m17_label_statistics", f"WITH {PART}, {TRI}, y AS (SELECT p_partkey AS node, p_partkey IN (SELECT unnest([x, y, z]) FROM tri) AS y FROM part), {LABEL} SELECT count(*) AS n, count(*) FILTER (WHERE y) AS pos, round(avg(y::INT), 9) AS rate, round(avg(y::INT) FILTER (WHERE part = 'train'), 9) AS train_rate FROM y JOIN nsplit USING (node)")
def _(t):
    y = t.part_nodes().join(ST.triangles_by_node(t.part_edges()), "node", "left").select("node", F.col("triangles").isNotNull().alias("y"))
    v = F.col("y").cast("double")
    return y.join(t.split_of_parts(), "node").agg(F.count("*").alias("n"), F.count_if("y").alias("pos"), F.round(F.avg(v), 9).alias("rate"), F.round(F.avg(F.when(F.col("part") == "train", v)), 9).alias("train_rate"))
