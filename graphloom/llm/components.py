"""Connected components of a narrow edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node of ``edges``; the root is the component's least node.

    Each round hooks every node to its least neighbour (one aggregation), jumps
    twice, and contracts the edges; a round's tables are written, so plans stay
    short. Self-loops count as nodes; nulls aren't nodes.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    live = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    steps = []
    while not live.isEmpty():
        near = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")), "hooks")
        jump = _through(_through(hook, hook), hook)
        jump = written(jump, "parents")
        steps.append(jump)
        for end in ("a", "b"):
            live = live.join(jump.withColumnRenamed("x", end), end).drop(end).withColumnRenamed("p", end)
        live = written(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    out = nodes.select("node", F.col("node").alias("root"))
    for step in steps:
        met = out.join(step, out["root"] == step["x"], "left")
        out = met.select("node", F.coalesce("p", "root").alias("root"))
    return out


def _through(parents: DataFrame, hook: DataFrame) -> DataFrame:
    """Each node's parent's parent."""
    up = hook.select(F.col("x").alias("y"), F.col("p").alias("q"))
    return parents.join(up, parents["p"] == up["y"], "left").select("x", F.coalesce("q", "p").alias("p"))
