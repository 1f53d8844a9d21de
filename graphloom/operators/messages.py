"""Relational message passing: states by (query, node), multiplied along edges by the relation's vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Relations whose vectors are broadcast at most.
RELATIONS = 1 << 16


def edge_vectors(edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """``src, dst, w0, ...``: parallel edges as one, with the sum of their relations' vectors (``vectors(rel, v0, ...)``).
    A message is a product with the vector, so that the sum over parallel edges may be taken first."""
    if vectors.limit(RELATIONS + 1).count() <= RELATIONS:
        vectors = F.broadcast(vectors)
    met = edges.select("src", "rel", "dst").join(vectors, "rel")
    return met.groupBy("src", "dst").agg(*[F.sum(f"v{k}").alias(f"w{k}") for k in range(dims)])


def relational_messages(boundary: DataFrame, edges: DataFrame, vectors: DataFrame, dims: int, layers: int, targets: DataFrame | None = None, short_cut: bool = False, activation=None) -> DataFrame:
    """``query, node, x0, ...``: states after ``layers`` steps from ``boundary(query, node, x0, ...)``.

    A step sends each state along the node's edges times the relation's vector, sums what comes in and adds the boundary again
    (``short_cut`` adds the state before as well); ``activation`` maps a column, after the sum. States that are zero
    have no row. With ``targets(query, node)`` the last step makes these states alone: they meet the edges that come in,
    then the states before, so that its work is that of the targets' degrees; where nothing but sums and products is asked
    for, both sides go half of the way (``_halfway``). Each step but the last is a written table.
    """
    names = [f"x{k}" for k in range(dims)]
    weighed = written(edge_vectors(edges, vectors, dims), "message-edges")
    boundary = written(boundary.select("query", "node", *names), "message-boundary")
    if targets is not None and activation is None and not short_cut and layers > 1:
        return _halfway(boundary, weighed, dims, layers, targets.select("query", "node").distinct())
    state = boundary
    for layer in range(layers):
        last = layer == layers - 1
        there = weighed.withColumnsRenamed({"src": "node"})
        if last and targets is not None:
            asked = targets.select("query", F.col("node").alias("dst")).distinct()
            met = asked.join(there, "dst").join(state, ["query", "node"])
        else:
            met = state.join(there, "node")
        sent = met.select("query", F.col("dst").alias("node"), *[(F.col(f"x{k}") * F.col(f"w{k}")).alias(f"x{k}") for k in range(dims)])
        parts = [sent, boundary, *([state] if short_cut else [])]
        if last and targets is not None:
            parts = [parts[0], *[p.join(targets.select("query", "node").distinct(), ["query", "node"], "left_semi") for p in parts[1:]]]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        summed = whole.groupBy("query", "node").agg(*[F.sum(n).alias(n) for n in names])
        if activation is not None:
            summed = summed.select("query", "node", *[activation(F.col(n)).alias(n) for n in names])
        state = summed if last else written(summed, "message-state")
    return state


def _halfway(boundary: DataFrame, weighed: DataFrame, dims: int, layers: int, targets: DataFrame) -> DataFrame:
    """States at ``targets`` as sums over paths of up to ``layers`` edges: half of the steps go from the boundary, the others back
    from the target nodes, which all queries share, and both meet by (target, node). No state is made that no target asks for
    beyond half of the way."""
    forth = layers // 2
    back = layers - forth
    names = [f"x{k}" for k in range(dims)]
    state = boundary
    for _ in range(forth):
        sent = state.join(weighed.withColumnRenamed("src", "node"), "node").select("query", F.col("dst").alias("node"), *[(F.col(f"x{k}") * F.col(f"w{k}")).alias(f"x{k}") for k in range(dims)])
        state = written(sent.unionByName(boundary).groupBy("query", "node").agg(*[F.sum(n).alias(n) for n in names]), "message-state")
    # r: products over the paths from a node to a target, by their number of edges
    ends = written(targets.select(F.col("node").alias("end")).distinct(), "message-ends")
    paths = ends.select("end", F.col("end").alias("node"), *[F.lit(1.0).alias(f"r{k}") for k in range(dims)])
    parts = []
    for step in range(back + 1):
        # the boundary enters after every step; over all remaining edges go the states from halfway
        start = state if step == back else boundary
        met = targets.withColumnRenamed("node", "end").join(start, "query").join(paths, ["end", "node"])
        parts.append(met.select("query", F.col("end").alias("node"), *[(F.col(f"x{k}") * F.col(f"r{k}")).alias(f"x{k}") for k in range(dims)]))
        if step < back:
            longer = paths.join(weighed.withColumnRenamed("dst", "node"), "node").groupBy("end", F.col("src").alias("node"))
            paths = written(longer.agg(*[F.sum(F.col(f"r{k}") * F.col(f"w{k}")).alias(f"r{k}") for k in range(dims)]), "message-paths")
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("query", "node").agg(*[F.sum(n).alias(n) for n in names])


def scored(states: DataFrame, queries: DataFrame, names: Sequence[str]) -> DataFrame:
    """``queries(query, node, q0, ...)`` with ``score``, the product of a state and the query's vector; zero without a state."""
    product = sum((F.col(n) * F.col(f"q{n[1:]}") for n in names), F.lit(0.0))
    return queries.join(states, ["query", "node"], "left").select(*queries.columns, F.coalesce(product, F.lit(0.0)).alias("score"))
