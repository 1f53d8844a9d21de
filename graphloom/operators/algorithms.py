"""Iterative graph algorithms as loops of joins; loops write their state to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw
from ..shared import written
from .links import ONE, node_degrees
from .meeting import overlaps
from .scans import dense_ids, numbered_within, prefix_sum


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once, as a table in the folder that the cluster shares."""
    return written(df, "step")


#: Levels of a search after which the nodes seen are put together.
_LEVELS = 16


def hops(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``node, hop``: least number of steps from the seeds, up to ``most``. Each level is computed once and kept by itself."""
    edges = settled(edges.select("src", "dst"))
    frontier = seen = settled(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    level = 0
    while (most is None or level < most) and not frontier.isEmpty():
        level += 1
        fresh = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = settled(fresh.join(seen, "node", "left_anti").withColumn("hop", F.lit(level)))
        seen = seen.unionByName(frontier)
        if level % _LEVELS == 0:
            seen = settled(seen)
    return seen


def queue_order(edges: DataFrame, seed: DataFrame, budget: int) -> DataFrame:
    """``node, hop, place`` of the first ``budget`` nodes that a breadth-first queue from one node takes in: parents
    in order, the neighbours of each by id. A level is numbered by its parents' places, and the last is cut."""
    edges = settled(edges.select("src", "dst"))
    frontier = seen = settled(seed.select("node", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("place")))
    level, total = 0, seen.count()
    while total < budget:
        level += 1
        reached = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("parent"))
        fresh = settled(reached.join(seen, "node", "left_anti"))
        # a parent's children are numbered among themselves, parents by how many came before
        own = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1)
        sizes = fresh.groupBy("parent").agg(F.count("*").alias("n"))
        numbered = own.join(prefix_sum(sizes, "parent", "n", "base").drop("n"), "parent")
        frontier = settled(numbered.select("node", F.lit(level).alias("hop"), (F.col("base") + F.col("nth") + total).alias("place")).where(F.col("place") < budget))
        found = frontier.count()
        if not found:
            break
        total += found
        seen = seen.unionByName(frontier)
    return seen


def diameter(nodes: DataFrame, edges: DataFrame, sources: int, seed: str) -> DataFrame:
    """``diameter, sources, reached``: the greatest eccentricity over so many sources, drawn by ``seed``
    (all nodes where there are fewer), and how many (source, node) pairs have a path. A node has a bit for each source,
    64 a column, so that a level sends a row an edge for all sources together."""
    from .splits import permuted

    edges = settled(edges.select("src", "dst"))
    drawn = permuted(nodes, seed).where(F.col("k") < sources)
    n, level = drawn.count(), 0
    bits = [f"b{c}" for c in range(-(-n // 64))]
    if not bits:
        return edges.agg(F.max(F.lit(None).cast("int")).alias("diameter"), F.lit(0).alias("sources"), F.lit(0).cast("long").alias("reached"))
    own = [F.when(F.floor(F.col("k") / 64) == c, F.expr("shiftleft(1L, cast(k % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(b) for c, b in enumerate(bits)]
    frontier = seen = settled(drawn.select("node", *own).groupBy("node").agg(*[F.bit_or(b).alias(b) for b in bits]))
    while True:
        near = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(*[F.bit_or(b).alias(b) for b in bits])
        known = seen.select("node", *[F.col(b).alias(f"s{b}") for b in bits])
        fresh = near.join(known, "node", "left").select("node", *[F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"s{b}", F.lit(0).cast("long")))).alias(b) for b in bits])
        frontier = settled(fresh.where(" OR ".join(f"{b} <> 0" for b in bits)))
        if frontier.isEmpty():
            break
        level += 1
        seen = settled(seen.unionByName(frontier).groupBy("node").agg(*[F.bit_or(b).alias(b) for b in bits]))
    return seen.agg(F.lit(level).alias("diameter"), F.lit(n).alias("sources"), F.sum(sum((F.bit_count(b) for b in bits), F.lit(0))).alias("reached"))


def bounded_distance(pairs: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``src, dst, hops``: the distance of each pair up to ``most`` (null beyond). A level looks for common neighbours of ``dst`` and
    the nodes so many steps from ``src``, by lists that meet in blocks; pairs that are found drop out. ``edges`` is symmetric."""
    edges = settled(edges.select("src", "dst").distinct())
    asked = settled(pairs.select("src", "dst").distinct())
    found = [asked.where("src = dst").withColumn("hops", F.lit(0))]
    left = asked.where("src <> dst")
    if most > 0:
        found.append(left.join(edges, ["src", "dst"], "left_semi").withColumn("hops", F.lit(1)))
        left = settled(left.join(edges, ["src", "dst"], "left_anti"))
    weighed = edges.withColumn("w", F.lit(1.0))
    front = left.withColumn("x", F.col("src"))
    for level in range(2, most + 1):
        met = overlaps(front.select(F.col("x").alias("src"), "dst").distinct(), weighed).select(F.col("src").alias("x"), "dst")
        hit = settled(front.join(met, ["x", "dst"], "left_semi").select("src", "dst").distinct())
        found.append(hit.withColumn("hops", F.lit(level)))
        if level < most:
            left = settled(left.join(hit, ["src", "dst"], "left_anti"))
            steps = edges.toDF("x", "y")
            front = settled(front.join(left, ["src", "dst"], "left_semi").join(steps, "x").select("src", "dst", F.col("y").alias("x")).distinct())
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return pairs.join(whole, ["src", "dst"], "left").select("src", "dst", "hops")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component (isolated nodes are their own), by hooking to the
    least neighbour and contracting: rounds grow with the logarithm of the longest path."""
    live = settled(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    out = nodes.select("node", F.col("node").alias("root"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")))
        up = hook.toDF("y", "q")
        jump = settled(hook.join(up, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p")))
        out = settled(out.join(jump, F.col("root") == F.col("x"), "left").select("node", F.coalesce("p", "root").alias("root")))
        left = live.join(jump.toDF("a", "pa"), "a").join(jump.toDF("b", "pb"), "b")
        live = settled(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct())
    return out


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component, of equals the one with the least node."""
    found = components(nodes, edges)
    top = found.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))  # one row
    return found.join(F.broadcast(top), "root", "left_semi").select("node")


def bridges(nodes: DataFrame, edges: DataFrame, seed: str, share: float = 0.05) -> DataFrame:
    """``u, v``: drawn new edges, each between a node of the largest component (of equals the one with the least node) and a node of
    another component, all components alike likely. There are half of ``share`` of the rows of ``edges`` (both directions), at least one;
    none where the graph is connected. Nodes are numbered within components, and drawn numbers meet them by equality.
    """
    found = settled(components(nodes, edges))
    sizes = settled(found.groupBy("root").agg(F.count("*").alias("size")))
    top = sizes.agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("top"))  # one row
    ranked = sizes.crossJoin(F.broadcast(top))
    others = dense_ids(ranked.where("root <> top").select("root", "size"), "root", "c")
    counts = others.agg(F.count("*").alias("n_others"))  # one row
    largest = ranked.where("root = top").select(F.col("root").alias("lcc"), F.col("size").alias("lcc_size"))  # one row
    pairs = max(1, (max(1, int(share * edges.count())) + 1) // 2)
    draws = nodes.sparkSession.range(pairs).withColumnRenamed("id", "k").crossJoin(F.broadcast(counts)).where("n_others > 0").crossJoin(F.broadcast(largest))
    drawn = draws.select("k", "lcc", (draw(seed, "c|", F.col("k")) % F.col("n_others")).alias("c"), (draw(seed, "u|", F.col("k")) % F.col("lcc_size")).alias("iu"))
    drawn = drawn.join(others, "c").withColumn("iv", draw(seed, "v|", F.col("k")) % F.col("size"))
    places = settled(numbered_within(found, "root", "node", "i").select("node", "root", "i"))
    u, v = places.toDF("nu", "ru", "pu"), places.toDF("nv", "rv", "pv")
    met = drawn.join(u, (F.col("ru") == F.col("lcc")) & (F.col("pu") == F.col("iu"))).join(v, (F.col("rv") == F.col("root")) & (F.col("pv") == F.col("iv")))
    return met.select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def bridged(nodes: DataFrame, edges: DataFrame, seed: str, share: float = 0.05, want: float = 0.5, rounds: int = 5) -> DataFrame:
    """``edges`` (both directions) with drawn bridges, round after round until the largest component holds over ``want`` of the
    nodes, ``rounds`` at most."""
    n = nodes.count()
    edges = settled(edges.select("src", "dst"))
    for k in range(rounds):
        if largest_component(nodes, edges).count() > want * n:
            break
        new = bridges(nodes, edges, f"{seed}{k}|", share)
        both = new.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")
        edges = settled(edges.unionByName(both))
    return edges


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """``node, rank`` after fixed rounds; the mass of dangling nodes isn't dealt out again."""
    n = nodes.agg(F.count("*").alias("n"))  # one row
    out = node_degrees(edges).toDF("src", "d")
    weighed = settled(edges.join(out, "src"))
    rank = nodes.crossJoin(F.broadcast(n)).select("node", "n", (ONE / F.col("n")).alias("rank"))
    for step in range(rounds):
        given = weighed.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        rank = rank.join(given, "node", "left").select("node", "n", ((1 - alpha) / F.col("n") + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if step % 8 == 7:
            rank = settled(rank)
    return rank.select("node", "rank")


def pagerank_until(nodes: DataFrame, edges: DataFrame, alpha: float, tolerance: float, start: DataFrame | None = None, most: int = 100, log: bool = False) -> DataFrame:
    """``node, rank`` once a round changes less than ``tolerance`` in sum. ``start(node, p)`` says where walks begin (all
    nodes alike without it). Dangling mass isn't dealt out again; ``log`` gives log(tolerance + rank)."""
    weighed = settled(edges.join(node_degrees(edges).toDF("src", "d"), "src").select("src", "dst", (ONE / F.col("d")).alias("w")))
    if start is None:
        n = nodes.agg(F.count("*").alias("n"))  # one row
        begin = nodes.crossJoin(F.broadcast(n)).select("node", (ONE / F.col("n")).alias("p"))
    else:
        begin = nodes.join(start, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    state = settled(begin.select("node", "p", F.col("p").alias("rank"), F.lit(1.0).alias("moved")))
    for _ in range(most):
        given = weighed.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        fresh = (1 - alpha) * F.col("p") + alpha * F.coalesce("got", F.lit(0.0))
        state = settled(state.join(given, "node", "left").select("node", "p", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved")))
        if (state.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return state.select("node", (F.log(F.col("rank") + tolerance) if log else F.col("rank")).alias("rank"))


def aggregate_neighbours(x: DataFrame, edges: DataFrame, how: str) -> DataFrame:
    """``node, i, x`` from the sources of each node's edges: sum, avg, min, max, or gcn (loops added, symmetric norm)."""
    if how == "gcn":
        looped = edges.select("src", "dst").unionByName(x.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
        d = node_degrees(looped)
        met = looped.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst").join(x.withColumnRenamed("node", "src"), "src")
        return met.groupBy(F.col("dst").alias("node"), "i").agg(F.sum(F.col("x") / F.sqrt(F.col("ds") * F.col("dd"))).alias("x"))
    met = edges.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "i").agg(F.expr(f"{how}(x)").alias("y"))
    return x.select("node", "i").join(met, ["node", "i"], "left").select("node", "i", F.coalesce("y", F.lit(0.0)).alias("x"))


def propagate(x: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``node, k, i, x``: features after 0 to ``rounds`` normalised steps."""
    out = x.withColumn("k", F.lit(0))
    for k in range(1, rounds + 1):
        x = aggregate_neighbours(x, edges, "gcn")
        out = out.unionByName(x.withColumn("k", F.lit(k)))
    return out


def nearest_labelled(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """Manhattan distance of each grid cell to the nearest labelled cell of its grid."""
    other = labelled.select(F.col("grid").alias("g"), F.col("row").alias("lr"), F.col("col").alias("lc"))
    met = cells.join(other, F.col("grid") == F.col("g"))
    return met.groupBy("grid", "row", "col").agg(F.min(F.abs(F.col("row") - F.col("lr")) + F.abs(F.col("col") - F.col("lc"))).alias("hop"))


def laplacian_encodings(nodes: DataFrame, edges: DataFrame, k: int, rounds: int = 12) -> DataFrame:
    """``node, pe``: approximations to the ``k`` smoothest non-constant eigenvectors of the normalised
    Laplacian, by orthogonal iteration on (I + normalised adjacency) / 2.

    A round is one join along the edges and one aggregation of a (k + 1)-square Gram
    matrix, which alone comes to the driver; vectors stay distributed. Signs are fixed
    by the largest entry's.
    """
    import numpy as np

    from ..functions.draws import uniform

    width = k + 1
    d = node_degrees(edges)
    weighed = edges.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst").select("src", "dst", (1.0 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    x = nodes.select("node", F.array(*[uniform(f"pe{c}|", F.col("node")) - 0.5 for c in range(width)]).alias("x"))
    for step in range(rounds):
        got = weighed.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col("w") * F.col("x")[c]).alias(f"y{c}") for c in range(width)])
        y = x.join(got, "node", "left").select("node", F.array(*[(F.col("x")[c] + F.coalesce(f"y{c}", F.lit(0.0))) / 2 for c in range(width)]).alias("x"))
        y = settled(y)
        gram = y.agg(*[F.sum(F.col("x")[a] * F.col("x")[b]).alias(f"g{a}_{b}") for a in range(width) for b in range(a, width)]).first()
        g = np.array([[gram[f"g{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(width)] for a in range(width)])
        values, vectors = np.linalg.eigh(g)
        scale = vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
        x = y.select("node", F.array(*[sum((F.col("x")[a] * float(scale[a, c]) for a in range(width)), F.lit(0.0)) for c in range(width)]).alias("x"))
    top = x.agg(*[F.max_by(F.col("x")[c], F.struct(F.round(F.abs(F.col("x")[c]), 9), -F.col("node"))).alias(f"t{c}") for c in range(1, width)]).first()
    return x.select("node", F.array(*[F.col("x")[c] * (-1.0 if (top[f"t{c}"] or 0) < 0 else 1.0) for c in range(1, width)]).alias("pe"))
