"""Random walks whose draws are functions of (seed, walk, step), one equi-join a step.

``transitions`` numbers every node's neighbours and carries, on each edge, what the
next step must know: the degree of its end and the place of the way back there. A
walk therefore knows its next edge's key (node, index) before it joins: a step is
one join on a unique key, and a hub's edges are spread over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, uniform
from ..functions.scalars import first_seen
from ..shared import written

#: Steps after which a long walk's state is written, so that plans stay short.
CUT = 32


def transitions(edges: DataFrame) -> DataFrame:
    """``src, i, dst, deg, dst_deg, back``: neighbours from 0 in order; ``back`` is the place of src among dst's."""
    own = Window.partitionBy("src")
    numbered = edges.select("src", "dst").distinct().select("src", "dst", (F.row_number().over(own.orderBy("dst")) - 1).alias("i"), F.count("*").over(own).alias("deg"))
    there = numbered.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("i").alias("back"), F.col("deg").alias("dst_deg"))
    return numbered.join(there, ["src", "dst"], "left").select("src", "i", "dst", "deg", F.coalesce("dst_deg", F.lit(0)).alias("dst_deg"), "back")


def _cut(state: DataFrame, step: int) -> DataFrame:
    return written(state, "walk") if step % CUT == 0 else state


def walk(starts: DataFrame, edges: DataFrame, length: int, seed: str, backtrack: bool = True, restart: float = 0.0, period: int = 0) -> DataFrame:
    """One row a start ``walk_id, node``: ``walk_id, path, restarts`` with ``length`` steps. A start may be a
    prefix ``walk_id, path`` instead: its walk goes on from the last node up to ``length`` steps in all, with the draws of its
    places, so that a walk cut anywhere goes on as it would have. Longer prefixes stay as they are.

    Without ``backtrack`` the previous node is skipped unless it is the only way on.
    ``restart``: the chance to return to the start, never twice in a row; ``period``:
    return at each multiple. A dead end stays where it is.
    """
    if restart and period:
        raise ValueError("a walk restarts by chance or by period, not both")
    steps = written(transitions(edges), "transitions")  # read at every step
    degree = steps.select(F.col("src").alias("node"), F.col("deg").alias("start_deg")).distinct()
    nothing = F.lit(None).cast("long")
    given = "path" in starts.columns
    if given:  # the place of the way back is that of the prefix's last step
        ends = starts.select("walk_id", "path", F.col("path")[0].alias("start"), F.element_at("path", -1).alias("node"), F.when(F.size("path") > 1, F.element_at("path", -2)).alias("from"))
        came = steps.select(F.col("src").alias("from"), F.col("dst").alias("node"), "back")
        first = degree.toDF("start", "start_deg")
        ends = ends.join(degree.toDF("node", "deg"), "node", "left").join(first, "start", "left").join(came, ["from", "node"], "left")
        marks = F.transform("path", lambda _: F.lit(False))
        state = ends.select("walk_id", "start", F.coalesce("start_deg", F.lit(0)).alias("start_deg"), "node", F.coalesce("deg", F.lit(0)).alias("deg"), F.col("back").cast("long").alias("back"), "path", marks.alias("restarts"))
    state = state if given else starts.join(degree, "node", "left").select(
        "walk_id", F.col("node").alias("start"), F.coalesce("start_deg", F.lit(0)).alias("start_deg"), "node",
        F.coalesce("start_deg", F.lit(0)).alias("deg"), nothing.alias("back"), F.array("node").alias("path"), F.array(F.lit(False)).alias("restarts"),
    )
    for step in range(1, length + 1):
        if period:
            again: Column = F.lit(step % period == 0)
        elif restart:
            again = (uniform(seed, "r|", F.col("walk_id"), "|", step) < restart) & ~F.element_at("restarts", -1)
        else:
            again = F.lit(False)
        choice = draw(seed, "|", F.col("walk_id"), "|", step)
        if backtrack:
            index = F.when(F.col("deg") > 0, choice % F.greatest("deg", F.lit(1)))
        else:
            skipped = choice % F.greatest(F.col("deg") - 1, F.lit(1))
            forward = skipped + (skipped >= F.col("back")).cast("long")
            index = F.when(F.col("deg") == 1, F.lit(0)).when(F.col("back").isNull(), F.when(F.col("deg") > 0, choice % F.greatest("deg", F.lit(1)))).otherwise(forward)
        if given:  # prefixes beyond this place wait
            going = F.size("path") == step
            again, index = again & going, F.when(going, index)
        asked = state.withColumns({"again": again, "index": index.cast("long")})
        on = (F.col("s.node") == F.col("e.src")) & (F.col("s.index") == F.col("e.i")) & ~F.col("s.again")
        met = asked.alias("s").join(steps.alias("e"), on, "left")
        node = F.when(F.col("again"), F.col("start")).otherwise(F.coalesce("dst", "node"))
        state = met.select(
            "walk_id", "start", "start_deg", node.alias("node"),
            F.when(F.col("again"), F.col("start_deg")).when(F.col("dst").isNull(), F.col("s.deg")).otherwise(F.col("dst_deg")).alias("deg"),
            F.when(~F.col("again") & F.col("dst").isNotNull(), F.col("e.back")).otherwise(F.when(F.size("path") > step, F.col("s.back")) if given else None).cast("long").alias("back"),
            *[F.when(F.size("path") > step, F.col(c)).otherwise(v).alias(c) if given else v.alias(c) for c, v in (("path", F.array_append("path", node)), ("restarts", F.array_append("restarts", F.col("again"))))],
        )
        state = _cut(state, step)
    return state.select("walk_id", "path", "restarts")


def weighted_walk(starts: DataFrame, weights: DataFrame, length: int, seed: str) -> DataFrame:
    """Steps by weight: ``weights(src, dst, w)`` become intervals of [0, 1), and a uniform draw picks one;
    a draw past the last bound takes the last neighbour.

    A node of d neighbours cuts [0, 1) into d cells; an interval has a row for each cell that it meets, two at
    most on average. A walk knows d, hence its draw's cell, before it joins: a hub's walks meet few rows each.
    """
    own = Window.partitionBy("src")
    upto = F.sum("w").over(own.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(own)
    bounds = weights.select("src", "dst", upto.alias("hi"), (F.row_number().over(own.orderBy(F.desc("dst"))) == 1).alias("final"), F.count("*").over(own).alias("d"))
    before = F.coalesce(F.lag("hi").over(own.orderBy("dst")), F.lit(0.0))
    bounds = bounds.select("src", "dst", "d", before.alias("lo"), F.when(F.col("final"), 2.0).otherwise(F.col("hi")).alias("hi"))
    degree = weights.groupBy("src").agg(F.count("*").alias("d"))
    last = F.col("d") - 1
    cells = F.sequence(F.least(F.floor(F.col("lo") * F.col("d")), last), F.least(F.floor(F.col("hi") * F.col("d")), last))
    steps = bounds.select("src", "dst", "lo", "hi", F.explode(cells).alias("cell")).join(degree.toDF("dst", "dst_d"), "dst", "left")
    steps = written(steps, "weighted")  # read at every step
    state = starts.join(degree.toDF("node", "d"), "node", "left").select("walk_id", "node", "d", F.array("node").alias("path"))
    for step in range(1, length + 1):
        x = uniform(seed, "|", F.col("walk_id"), "|", step)
        drawn = state.withColumn("x", x).withColumn("at", F.floor(F.col("x") * F.col("d")))
        met = drawn.join(steps, (F.col("node") == F.col("src")) & (F.col("at") == F.col("cell")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")), "left")
        node = F.coalesce("dst", "node")
        state = met.select("walk_id", node.alias("node"), F.when(F.col("dst").isNull(), F.col("d")).otherwise(F.col("dst_d")).alias("d"), F.array_append("path", node).alias("path"))
        state = _cut(state, step)
    return state.select("walk_id", "path")


def second_order_walk(starts: DataFrame, edges: DataFrame, length: int, seed: str, p: float, q: float) -> DataFrame:
    """Weights 1/p back to the previous node, 1 to its neighbours, 1/q elsewhere; the draw picks by cumulated weight."""
    links = edges.select("src", "dst").distinct()
    known = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("near"))
    state = starts.select("walk_id", "node", F.lit(None).cast("long").alias("prev"), F.array("node").alias("path"))
    for step in range(1, length + 1):
        asked = state.withColumn("x", uniform(seed, "|", F.col("walk_id"), "|", step))
        options = asked.join(links, F.col("node") == F.col("src"), "left").join(known, (F.col("prev") == F.col("a")) & (F.col("dst") == F.col("b")), "left")
        w = F.when(F.col("prev").isNull() | F.col("near").isNotNull(), 1.0).when(F.col("dst") == F.col("prev"), 1 / p).otherwise(1 / q)
        own = Window.partitionBy("walk_id")
        upto = F.sum("w").over(own.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0))
        weighed = options.withColumn("w", w).withColumns({"hi": upto, "total": F.sum("w").over(own), "last": F.row_number().over(own.orderBy(F.desc("dst"))) == 1})
        open_ = weighed.where((F.round(F.col("hi"), 9) > F.round(F.col("x") * F.col("total"), 9)) | F.col("last"))
        chosen = open_.groupBy("walk_id").agg(F.min_by(F.struct("node", "dst", "path"), F.struct(F.col("dst"))).alias("c"))
        node = F.coalesce("c.dst", "c.node")
        state = chosen.select("walk_id", node.alias("node"), F.col("c.node").alias("prev"), F.array_append("c.path", node).alias("path"))
        state = _cut(state, step)
    return state.select("walk_id", "path")


def positions(walks: DataFrame) -> DataFrame:
    """``walk_id, pos, node[, restart]``."""
    if "restarts" in walks.columns:
        return walks.select("walk_id", F.posexplode(F.arrays_zip("path", "restarts")).alias("pos", "x")).select("walk_id", "pos", F.col("x.path").alias("node"), F.col("x.restarts").alias("restart"))
    return walks.select("walk_id", F.posexplode("path").alias("pos", "node"))


def anonymised(walks: DataFrame) -> DataFrame:
    """The path with every node replaced by the rank of its first visit."""
    return walks.withColumn("anon", first_seen(F.col("path")))


def as_text(nodes: Column, restarts: Column | None = None) -> Column:
    """Ids joined by '-', with ';' before a restart."""
    if restarts is None:
        return F.array_join(nodes, "-")
    parts = F.zip_with(nodes, restarts, lambda n, r: F.concat(F.when(r, ";").otherwise("-"), n.cast("string")))
    return F.substring(F.array_join(parts, ""), 2, 1 << 30)


def step_types(places: DataFrame, triples: DataFrame, seed: str, only_forward: bool = False) -> DataFrame:
    """``walk_id, pos, rel, dir`` of each step: one of the matching edges by draw, 0 forward, 1 backward, 2 a loop;
    nulls where no edge matches, as at starts and restarts. With ``only_forward`` steps against an edge match none."""
    own = Window.partitionBy("walk_id").orderBy("pos")
    moves = places.withColumn("prev", F.lag("node").over(own))
    if "restart" in places.columns:
        moves = moves.withColumn("prev", F.when(~F.col("restart"), F.col("prev")))
    ahead = triples.select(F.col("h").alias("a"), F.col("t").alias("b"), F.col("r").alias("rel"), F.when(F.col("h") == F.col("t"), 2).otherwise(0).alias("dir"))
    behind = triples.select(F.col("t").alias("a"), F.col("h").alias("b"), F.col("r").alias("rel"), F.when(F.col("h") == F.col("t"), 2).otherwise(1).alias("dir"))
    edges = ahead if only_forward else ahead.unionByName(behind)
    met = moves.join(edges, (F.col("prev") == F.col("a")) & (F.col("node") == F.col("b")), "left")
    by = draw(seed, "|", F.col("walk_id"), "|", F.col("pos"), "|", F.coalesce(F.col("rel"), F.lit(-1)), "|", F.coalesce(F.col("dir"), F.lit(-1)))
    return met.groupBy("walk_id", "pos").agg(F.min_by(F.struct("rel", "dir"), F.struct(by, "rel", "dir")).alias("m")).select("walk_id", "pos", "m.rel", "m.dir")


def balanced_starts(edges: DataFrame, per_type: int, seed: str) -> DataFrame:
    """``per_type`` edges of each relation by draw; a smaller group is repeated in turn."""
    own = Window.partitionBy("rel")
    ranked = edges.select("src", "dst", "rel", (F.row_number().over(own.orderBy(draw(seed, F.col("src"), "|", F.col("dst"), "|", F.col("rel")), "src", "dst")) - 1).alias("k"), F.count("*").over(own).alias("n"))
    turns = F.sequence(F.col("k"), F.lit(per_type - 1), F.col("n").cast("int"))
    return ranked.where(F.col("k") < per_type).select("rel", F.explode(turns).alias("j"), "src", "dst")


MODES = ("default", "train_only", "train_chunk", "batch_only")


def start_nodes(mode: str, train: DataFrame, batch: DataFrame, walks: int, refinements: int, seed: str, focus: DataFrame | None = None, short: bool = False) -> DataFrame:
    """``refinement, slot, kind, node``: where the walks of a node task begin; tables of ``node``.

    ``default``: one and a half times ``walks`` starts a refinement drawn from training nodes (twice as many, of half the length,
    with ``short``), then as many drawn from the batch. ``train_only``: all of three times ``walks`` drawn from training nodes.
    ``train_chunk`` and ``batch_only``: so many over the nodes of ``focus`` or the batch in turn, so that in each refinement a node has
    as many starts as any other, but for one; every turn begins at a drawn place of a drawn order. Draws meet numbered nodes by equality.
    """
    if mode not in MODES or mode == "train_chunk" and focus is None:
        raise ValueError(f"mode is one of {MODES}, and train_chunk needs the nodes to walk from")
    from .splits import permuted

    spark, t = train.sparkSession, refinements
    low, high = int(1.5 * walks * t), -int(-1.5 * walks * t // 1)

    def drawn(kind: str, nodes: DataFrame, first: int, count: int) -> DataFrame:
        rows = spark.range(first, first + count).withColumnRenamed("id", "row")
        n = nodes.agg(F.count("*").alias("n"))  # one row
        asked = rows.crossJoin(F.broadcast(n)).where("n > 0").withColumn("k", draw(seed, kind, "|", F.col("row")) % F.col("n"))
        met = asked.join(permuted(nodes.select("node").distinct(), f"{seed}{kind}|"), "k")
        return met.select((F.col("row") % t).cast("int").alias("refinement"), F.floor(F.col("row") / t).alias("slot"), F.lit(kind).alias("kind"), "node")

    if mode == "default":
        first = 2 * low if short else low
        return drawn("train", train, 0, first).unionByName(drawn("batch", batch, first, high))
    slots = max(1, (low + high) // t)
    if mode == "train_only":
        return drawn("train", train, 0, slots * t)
    kind, nodes = ("focus", focus) if mode == "train_chunk" else ("batch", batch)
    n = nodes.select("node").distinct().agg(F.count("*").alias("n"))  # one row
    rows = spark.range(slots).withColumnRenamed("id", "slot").crossJoin(spark.range(t).select(F.col("id").cast("int").alias("refinement"))).crossJoin(F.broadcast(n)).where("n > 0")
    turn = draw(seed, kind, "|", F.col("refinement"), "|", F.floor(F.col("slot") / F.col("n")))
    asked = rows.withColumn("k", (F.col("slot") + turn) % F.col("n"))
    return asked.join(permuted(nodes.select("node").distinct(), f"{seed}{kind}|"), "k").select("refinement", "slot", F.lit(kind).alias("kind"), "node")


def budget(nodes: Column) -> Column:
    """Walks and steps for a graph's size: the smallest tier that holds it."""
    tier = [(1000, 32, 32), (10000, 64, 128), (40000, 128, 128)]
    out = F.struct(F.lit(256).alias("walks"), F.lit(128).alias("steps"))
    for most, walks, steps in reversed(tier):
        out = F.when(nodes <= most, F.struct(F.lit(walks).alias("walks"), F.lit(steps).alias("steps"))).otherwise(out)
    return out


def adaptive(walks: Column, nodes: Column) -> Column:
    """A quarter of the walks on graphs under 1000 nodes, half of them under 8000."""
    return F.when(nodes < 1000, F.floor(walks / 4)).when(nodes < 8000, F.floor(walks / 2)).otherwise(walks).cast("int")


def feature_cap(walks: Column, features: Column) -> Column:
    """At most 64 walks where nodes have over 16 features."""
    return F.when(features > 16, F.least(walks, F.lit(64))).otherwise(walks)


def link_starts(heads: DataFrame, edges: DataFrame, n_nodes: int, walks: int, seed: str) -> DataFrame:
    """``kind, key, j, node``: for each query head (``key``) ``walks`` starts there and as many at random nodes, and
    ``walks // relations + 1`` starts of edges of each relation (``key``), a smaller relation's in turn."""
    per_query = heads.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)).cast("array<bigint>")))
    own = per_query.select(F.lit("query").alias("kind"), "key", "j", F.col("key").alias("node"))
    anywhere = per_query.select(F.lit("random").alias("kind"), "key", "j", (draw(f"{seed}n|", F.col("key"), "|", F.col("j")) % n_nodes).alias("node"))
    relations = edges.select("rel").distinct().count()
    tied = balanced_starts(edges, walks // max(relations, 1) + 1, f"{seed}|")
    return own.unionByName(anywhere).unionByName(tied.select(F.lit("edge").alias("kind"), F.col("rel").cast("long").alias("key"), F.col("j").cast("long").alias("j"), F.col("src").alias("node")))


def previous_beside_records(places: DataFrame) -> DataFrame:
    """``prev``: the node of the last place before that is no neighbour record (``is_nbr``)."""
    before = Window.partitionBy("walk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return places.select("walk_id", "pos", "node", F.last_value(F.when(~F.col("is_nbr"), F.col("node")), F.lit(True)).over(before).alias("prev"))


def random_walks(starts: DataFrame, edges: DataFrame, length: int, seed: str, *, backtrack: bool = True, restart: float = 0.0, period: int = 0, p: float = 1.0, q: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """The walk that the arguments ask for: uniform, without backtracking, restarting, of second order (``p, q``) or weighted.
    Restarts by chance and by period exclude each other, and both exclude second order and weights."""
    second = (p, q) != (1.0, 1.0)
    if not 0.0 <= restart < 1.0 or period < 0 or length < 1 or p <= 0 or q <= 0:
        raise ValueError("restart lies in [0, 1), period isn't negative, length, p and q are positive")
    if restart and period or (second or weights is not None) and (restart or period or not backtrack) or second and weights is not None:
        raise ValueError("these ways to walk exclude each other")
    if second:
        return second_order_walk(starts, edges, length, seed, p, q)
    if weights is not None:
        return weighted_walk(starts, weights, length, seed)
    return walk(starts, edges, length, seed, backtrack, restart, period)


def with_neighbours(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """``walk_id, pos, node, anon, is_nbr[, restart]``: after a node's first visit, records of its
    neighbours that the walk has seen (but for the one it comes from), by rank of first visit;
    cut at the walk's length. Two equi-joins over first visits; nothing is gathered."""
    from .algorithms import settled

    walks = settled(walks)  # read five times below
    rows = positions(walks)
    own = Window.partitionBy("walk_id")
    length = walks.select("walk_id", F.size("path").alias("len"))
    first = rows.groupBy("walk_id", "node").agg(F.min("pos").alias("first"))
    ranked = first.withColumn("anon", F.row_number().over(own.orderBy("first")))
    before = rows.select("walk_id", (F.col("pos") + 1).alias("first"), F.col("node").alias("prev"))
    seen = ranked.select(F.col("walk_id").alias("w"), F.col("node").alias("m"), F.col("first").alias("m_first"), F.col("anon").alias("m_anon"))
    links = ranked.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src"))
    met = links.join(seen, (F.col("walk_id") == F.col("w")) & (F.col("dst") == F.col("m"))).where("m_first <= first")
    met = met.join(before, ["walk_id", "first"], "left").where("prev IS NULL OR prev <> m")
    extra = met.select("walk_id", F.col("first").alias("at"), F.col("m").alias("node"), F.col("m_anon").alias("anon"), F.lit(True).alias("is_nbr"))
    base = rows.join(ranked.drop("first"), ["walk_id", "node"]).select("walk_id", F.col("pos").alias("at"), "node", "anon", F.lit(False).alias("is_nbr"))
    order = own.orderBy("at", "is_nbr", "anon")
    placed = base.unionByName(extra).withColumn("pos", F.row_number().over(order) - 1).join(length, "walk_id").where("pos < len")
    out = placed.select("walk_id", "pos", "node", "anon", "is_nbr", "at")
    if "restart" in rows.columns:
        marks = rows.select("walk_id", F.col("pos").alias("at"), "restart")
        out = out.join(marks, ["walk_id", "at"]).withColumn("restart", F.col("restart") & ~F.col("is_nbr"))
    return out.drop("at")
