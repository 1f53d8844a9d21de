"""Queries of quantile grids, categorical plans, smoothed singular vectors, and of graphs with hubs, isolated nodes and many components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import samplers as SA
from ..functions.draws import draw_sql
from ..operators import algorithms as A
from ..operators import tabular as T
from ..sources.fixtures import HUB, PART
from .registry import query

# Quantile grid.

_U = [f"({draw_sql(f"'fe7|' || node || '|{k}'")} / 4294967296.0::DOUBLE)" for k in "ra"]


def _tail_sql(x: str) -> str:
    (a, b), s = T._TAIL, f"sqrt(-2 * ln({x}))"
    horner = lambda f: "".join("(" for _ in f[1:]) + f"{f[0]}::DOUBLE" + "".join(f" * {s} + {c}::DOUBLE)" for c in f[1:])
    return f"{horner(a)} / {horner(b)}"


def _grid_sql(table: str, key: str, column: str, normal: bool) -> str:
    mid = lambda f, r: "".join("(" for _ in f[1:]) + f"{f[0]}::DOUBLE" + "".join(f" * {r} + {c}::DOUBLE)" for c in f[1:])
    inverse = f"CASE WHEN p < {T._LOW} THEN {_tail_sql('p')} WHEN p > 1 - {T._LOW} THEN -({_tail_sql('(1 - p)')}) ELSE {mid(T._MIDDLE[0], '((p - 0.5) * (p - 0.5))')} * (p - 0.5) / {mid(T._MIDDLE[1], '((p - 0.5) * (p - 0.5))')} END"
    edge = T.EDGE - float(__import__("numpy").spacing(1.0))
    value = f"(SELECT {inverse} FROM (SELECT greatest({edge}::DOUBLE, least(1 - {edge}::DOUBLE, place)) AS p))" if normal else "place"
    return f"""WITH x AS (SELECT {key} AS node, {column}::DOUBLE AS x FROM {table}), j AS (SELECT x + sqrt(-2 * ln(1 - {_U[0]})) * cos(2 * pi() * {_U[1]}) * {T.JITTER} AS x FROM x),
k AS (SELECT least(greatest(least(count(*) // 30, 1000), 10), count(*)) AS k FROM x), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM j),
spots AS (SELECT j, j * ((SELECT count(*) FROM x) - 1.0::DOUBLE) / ((SELECT k FROM k) - 1) AS pos FROM unnest(range(0, (SELECT k FROM k))) AS u(j)),
g AS (SELECT list(a.x + (b.x - a.x) * (pos - floor(pos)) ORDER BY j) AS g FROM spots JOIN o a ON a.i = floor(pos)::BIGINT JOIN o b ON b.i = least(floor(pos)::BIGINT + 1, a.n - 1)),
c AS (SELECT node, x, g, len(list_filter(g, lambda v: v < x)) AS below, len(list_filter(g, lambda v: v <= x)) AS upto FROM x, g),
p AS (SELECT node, CASE WHEN x - {T.EDGE} < g[1] THEN 0.0::DOUBLE WHEN x + {T.EDGE} > g[len(g)] THEN 1.0::DOUBLE WHEN upto > below THEN (below + upto - 1) / 2.0::DOUBLE / (len(g) - 1) ELSE (upto - 1 + (x - g[upto]) / (g[upto + 1] - g[upto])) / (len(g) - 1) END AS place FROM c)
SELECT node, round({value}, 5) + 0.0::DOUBLE AS q FROM p"""


def _grid(t, normal):
    x = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_extendedprice").cast("double").alias("x"))
    grid = T.quantile_grid(x, "x", SA.normal(("fe7|", F.col("node")), 0.0, T.JITTER))
    return T.quantile_transform(x, "x", "q", grid, normal).select("node", (F.round("q", 5) + 0.0).alias("q"))


@query("fe7_quantile_grid", _grid_sql("lineitem", "l_orderkey * 10 + l_linenumber", "l_extendedprice", False))
def _(t):
    return _grid(t, False)


@query("fe7_quantile_grid_normal", _grid_sql("lineitem", "l_orderkey * 10 + l_linenumber", "l_extendedprice", True))
def _(t):
    return _grid(t, True)


# Categorical plan.

COLUMNS, SEED, MOST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"], "fe15", 7
PLAN = T.category_plan(COLUMNS, SEED, 0.7, MOST, 0.5)


def _plan_sql() -> str:
    out = []
    for p in PLAN:
        if p.kind == "kept":
            out.append(f"{p.column}::DOUBLE")
            continue
        raw = " + ".join(f"coalesce(({p.column} > (SELECT {p.column} FROM cuts WHERE k = {c}))::INT, 0)" for c in p.cuts)
        named = f"CASE {raw} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(p.classes)) + " END"
        out += [f"coalesce(({named} = {c})::INT, 0)::DOUBLE" for c in range(len(p.classes))] if p.kind == "onehot" else [f"({named})::DOUBLE"]
    order = T.shuffled(list(range(len(out))), f"{SEED}|order")
    return f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS node, * FROM lineitem), cuts AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(f"'{SEED}|row|' || node")}, node) - 1 AS k FROM l QUALIFY k < {MOST - 1})
SELECT node, {", ".join(f"{out[k]} AS f{i}" for i, k in enumerate(order))} FROM l"""


@query("fe15_category_plan", _plan_sql())
def _(t):
    return T.categorised(t.lineitem.withColumn("node", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "node", PLAN, SEED, MOST)


# Smoothing and singular vectors: a part's vector is an embedding, dealt in turn.


def _vectors(t):
    n = t.embeddings.agg(F.count("*").alias("n"))  # one row
    return t.part_nodes().crossJoin(F.broadcast(n)).select("node", (F.col("node") % F.col("n")).alias("vec_id")).join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("node", "embedding")


@query("fe5_smoothed_features", f"""WITH {PART}, x0 AS (SELECT p_partkey AS node, i - 1 AS i, embedding[i]::DOUBLE AS x FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings), unnest(range(1, len(embedding) + 1)) AS u(i)),
lp AS (SELECT src, dst FROM edges UNION ALL SELECT p_partkey, p_partkey FROM part), d AS (SELECT src AS node, count(*) AS d FROM lp GROUP BY src), w AS (SELECT src, dst, 1 / sqrt(a.d * b.d) AS w FROM lp JOIN d a ON a.node = src JOIN d b ON b.node = dst),
x1 AS (SELECT dst AS node, i, sum(x * w) AS x FROM x0 JOIN w ON w.src = node GROUP BY dst, i), x2 AS (SELECT dst AS node, i, sum(x * w) AS x FROM x1 JOIN w ON w.src = node GROUP BY dst, i) SELECT node, i, round(x, 6) + 0.0::DOUBLE AS x FROM x2""")
def _(t):
    return T.smoothed(_vectors(t), t.part_edges(), "node", "embedding", 2).select("node", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query("fe5_smoothed_svd")
def _(t):
    rows, values = T.truncated_svd(T.smoothed(_vectors(t), t.part_edges(), "node", "embedding", 2), "node", "v", 8)
    return rows.select("node", F.transform("u", lambda x: F.round(x, 6)).alias("u"), F.array(*[F.lit(round(float(v), 6)) for v in values]).alias("singular_values"))


# The graph of hubs.

_ROOTS = """reach(node, root) AS (SELECT node, node FROM hnodes UNION SELECT dst, root FROM reach JOIN hedges ON src = node), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


@query("it6_hub_components", f"WITH RECURSIVE {HUB}, {_ROOTS} SELECT node, root FROM comp")
def _(t):
    return A.components(t.hub_nodes(), t.hub_edges())


@query("it6_bridges", f"""WITH RECURSIVE {HUB}, {_ROOTS}, sizes AS (SELECT root, count(*) AS size FROM comp GROUP BY root), top AS (SELECT root, size FROM sizes ORDER BY size DESC, root LIMIT 1),
others AS (SELECT root, size, row_number() OVER (ORDER BY root) - 1 AS c FROM sizes WHERE root <> (SELECT root FROM top)), places AS (SELECT node, root, row_number() OVER (PARTITION BY root ORDER BY node) - 1 AS i FROM comp),
ks AS (SELECT k FROM unnest(range(0, (SELECT greatest(1, (greatest(1, floor(0.05 * count(*))::BIGINT) + 1) // 2) FROM hedges))) AS u(k)),
dr AS (SELECT k, {draw_sql("'it6|c|' || k")} % (SELECT count(*) FROM others) AS c, {draw_sql("'it6|u|' || k")} % (SELECT size FROM top) AS iu FROM ks)
SELECT a.node AS u, b.node AS v FROM dr JOIN others o USING (c) JOIN places a ON a.root = (SELECT root FROM top) AND a.i = iu JOIN places b ON b.root = o.root AND b.i = {draw_sql("'it6|v|' || k")} % o.size""")
def _(t):
    return A.bridges(t.hub_nodes(), t.hub_edges(), "it6|")


@query("it6_bridged_share")
def _(t):
    """Nodes of the largest component before and after bridging, and rows of edges."""
    nodes, edges = t.hub_nodes(), t.hub_edges()
    after = A.bridged(nodes, edges, "it6|")
    tally = [A.largest_component(nodes, e).agg(F.count("*").alias(f"nodes_{k}")).crossJoin(e.agg(F.count("*").alias(f"edges_{k}"))) for k, e in (("before", edges), ("after", after))]  # one row each
    return tally[0].crossJoin(tally[1])


@query("it7_hub_pagerank", f"WITH {HUB}, d AS (SELECT src, count(*) AS d FROM hedges GROUP BY src), n AS (SELECT count(*) AS n FROM hnodes), " + ", ".join(f"r{k} AS (SELECT h.node, 0.15 / n + 0.85 * coalesce(g, 0) AS r FROM hnodes h CROSS JOIN n LEFT JOIN (SELECT e.dst, sum({'1.0::DOUBLE / n' if k == 1 else 'p.r'} / d.d) AS g FROM hedges e JOIN d USING (src) {'CROSS JOIN n' if k == 1 else f'JOIN r{k - 1} p ON p.node = e.src'} GROUP BY e.dst) x ON x.dst = h.node)" for k in range(1, 4)) + " SELECT node, round(r, 12) AS rank FROM r3")
def _(t):
    return A.pagerank(t.hub_nodes(), t.hub_edges(), 0.85, 3).select("node", F.round("rank", 12).alias("rank"))


@query("it7_personalised_pagerank")
def _(t):
    """Walks that begin at the first nation, until a round moves less than 1e-6 in sum."""
    start = t.nation.agg(F.min("n_nationkey").alias("node")).withColumn("p", F.lit(1.0))
    return A.pagerank_until(t.hub_nodes(), t.hub_edges(), 0.85, 1e-6, start).select("node", F.round("rank", 6).alias("rank"))
