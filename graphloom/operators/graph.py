"""Graph-table algebra: edges are rows (src, dst[, rel, ...]), nodes are rows (node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import dense_ids, prefix_sum


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def lost_inverses(edges: DataFrame) -> DataFrame:
    """Kept edges whose inverse is gone: must be empty after a filter that treats both alike."""
    return edges.join(edges.select(F.col("edge_id").alias("there")), F.col("inv_edge_id") == F.col("there"), "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge turned round; other columns stay."""
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*[turned.get(c, F.col(c)) for c in edges.columns])


def symmetrise(edges: DataFrame, loops: bool = True) -> DataFrame:
    """Both directions of every edge, each once."""
    both = edges.unionByName(reverse(edges)).distinct()
    return both if loops else remove_self_loops(both)


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, as src < dst, loops dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges that occur more often than their reverse; none means the multigraph is undirected."""
    return edges.select("src", "dst").exceptAll(reverse(edges.select("src", "dst")))


def add_inverse(edges: DataFrame, relations: int) -> DataFrame:
    """Inverse edges ``(v, u, r + R)`` beside the given ones; ids go on after the largest, and each edge names its inverse."""
    n = edges.agg((F.max("edge_id") + 1).alias("n"))
    forward = edges.crossJoin(F.broadcast(n))  # one row
    there = forward.withColumns({"inv_edge_id": F.col("edge_id") + F.col("n"), "is_inverse": F.lit(False)})
    back = reverse(forward).withColumns(
        {"rel": F.col("rel") + relations, "inv_edge_id": F.col("edge_id"), "is_inverse": F.lit(True), "edge_id": F.col("edge_id") + F.col("n")}
    )
    return there.unionByName(back).drop("n")


def inverse_map(edges: DataFrame) -> DataFrame:
    """``edge_id, inv_edge_id`` by matching (u, v, r) with (v, u, r)."""
    other = edges.select(F.col("src").alias("d"), F.col("dst").alias("s"), F.col("rel").alias("r"), F.col("edge_id").alias("inv_edge_id"))
    return edges.join(other, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) & (F.col("rel") == F.col("r"))).select("edge_id", "inv_edge_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree`` with zero for isolated nodes."""
    counted = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def row_pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree, start``: where each node's neighbours start in the edges sorted by (src, dst)."""
    return prefix_sum(degrees(nodes, edges), "node", "degree", "start")


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, i, dst, deg``: neighbours numbered from 0 in order."""
    own = Window.partitionBy("src")
    return edges.select("src", (F.row_number().over(own.orderBy("dst")) - 1).alias("i"), "dst", F.count("*").over(own).alias("deg"))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))


def induced_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep(node)``, ends renumbered densely in order of id."""
    ids = dense_ids(keep.select("node").distinct(), "node", "new_id")
    left, right = ids.toDF("src", "new_src"), ids.toDF("dst", "new_dst")
    return edges.join(left, "src").join(right, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def drop_edges(edges: DataFrame, batch: DataFrame, relations: int | None = None) -> DataFrame:
    """``edges`` without a batch and its reverses (inverse relations where ``relations`` is given)."""
    if relations is None:
        return edges.join(symmetrise(batch.select("src", "dst")), ["src", "dst"], "left_anti")
    back = reverse(batch.select("src", "rel", "dst")).withColumn("rel", (F.col("rel") + relations) % (2 * relations))
    return edges.join(batch.select("src", "rel", "dst").unionByName(back).distinct(), ["src", "rel", "dst"], "left_anti")


def ordered_union(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the tables in turn, the first of equal keys: ``ord`` is the table it came from."""
    whole = None
    for k, table in enumerate(tables):
        part = table.select(*keys).withColumn("ord", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy(*keys).agg(F.min("ord").alias("ord"))


def disjoint_union(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    shifted = b.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset})
    return a.unionByName(shifted)


def relation_lists(triples: DataFrame) -> DataFrame:
    """``(h, r) -> tails``, the filter index as rows."""
    return triples.groupBy("h", "r").agg(F.sort_array(F.collect_set("t")).alias("tails"))


def with_inverse_triples(triples: DataFrame, relations: int) -> DataFrame:
    back = triples.select(F.col("t").alias("h"), (F.col("r") + relations).alias("r"), F.col("h").alias("t"))
    return triples.select("h", "r", "t").unionByName(back).distinct()


def bundle(context: DataFrame, **queries: DataFrame) -> DataFrame:
    """One row a triple with flags: ``visible`` for the context and ``is_<name>`` for each query set; overlaps keep all flags."""
    names = list(queries)
    whole = context.select("h", "r", "t").withColumn("part", F.lit("visible"))
    for name in names:
        whole = whole.unionByName(queries[name].select("h", "r", "t").withColumn("part", F.lit(name)))
    flags = [F.bool_or(F.col("part") == "visible").alias("visible")] + [F.bool_or(F.col("part") == n).alias(f"is_{n}") for n in names]
    return whole.groupBy("h", "r", "t").agg(*flags)


def undirected_bundle(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """From ``src, dst, split[, rel]``: both directions of train edges are visible and trained on; an edge
    of another split is one query (src < dst), unless either direction is a train edge."""
    keys = keys or []
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *keys, "split").distinct()
    train = pairs.where("split = 'train'").drop("split")
    seen = train.select("src", "dst", *keys)
    held = pairs.where("split <> 'train'").join(seen, ["src", "dst", *keys], "left_anti")
    return symmetrise(seen).withColumn("split", F.lit("train")).unionByName(held)


def filter_set(triples: DataFrame, mode: str, split: str) -> DataFrame:
    """Known positives that a ranking leaves out, from ``h, r, t, visible, is_train, is_val, is_test``."""
    query = F.col(f"is_{split}")
    if mode == "transductive":
        chosen = F.col("is_train") | F.col("is_val") | F.col("is_test") | F.col("visible")
    elif mode in ("grail", "hm_mtdea"):
        chosen = F.col("visible") | query
    elif mode == "ilpc":
        chosen = F.col("visible") | query | (F.col("is_val") if split == "test" else F.lit(False))
    else:
        raise ValueError(f"no such filter mode: {mode}")
    return triples.where(chosen).select("h", "r", "t").distinct()


def positive_set(triples: DataFrame, mode: str, relations: int) -> DataFrame:
    """Edges that a negative must not hit: all of them, or what training sees."""
    chosen = triples if mode == "all_positives" else triples.where("visible OR is_train")
    return with_inverse_triples(chosen, relations)


def query_directions(queries: DataFrame, relations: int | None = None) -> DataFrame:
    """Tail and head prediction: as an inverse relation where there are any, else with a flag."""
    if relations is not None:
        back = queries.select(F.col("t").alias("h"), ((F.col("r") + relations) % (2 * relations)).alias("r"), F.col("h").alias("t"))
        return queries.select("h", "r", "t").unionByName(back)
    return queries.select("h", "r", "t", F.explode(F.array(F.lit(False), F.lit(True))).alias("predict_head"))


def node_roles(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid, node, role``: 2 for the query's node, 1 for its neighbours along the relation in the asked direction."""
    q = queries.select("qid", "r", "predict_head", F.when(F.col("predict_head"), F.col("t")).otherwise(F.col("h")).alias("node"))
    own = q.select("qid", "node", F.lit(2).alias("role"))
    tails = q.where("NOT predict_head").join(edges, (F.col("node") == F.col("src")) & (F.col("r") == F.col("rel"))).select("qid", F.col("dst").alias("node"), F.lit(1).alias("role"))
    heads = q.where("predict_head").join(edges, (F.col("node") == F.col("dst")) & (F.col("r") == F.col("rel"))).select("qid", F.col("src").alias("node"), F.lit(1).alias("role"))
    return own.unionByName(tails).unionByName(heads).groupBy("qid", "node").agg(F.max("role").alias("role"))
