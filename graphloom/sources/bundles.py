"""Readers of graph folders: knowledge graphs of three, four or five triple files, and tables of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import texts


def _scope(spark: SparkSession, folder: str, files: dict[str, str], relations: DataFrame, order: str, counted: tuple[str, ...]) -> DataFrame:
    """``h, r, t, part``: the files' triples as numbers. ``files`` names each part's file; the vocabulary is that of the
    ``counted`` parts, in order of first sight, with those that other parts add behind it."""
    names = [*counted, *[p for p in files if p not in counted]]
    found = texts.triples(texts.lines_of(spark, *[f"{folder.rstrip('/')}/{files[p]}" for p in names]), order)
    part = F.element_at(F.array(*map(F.lit, names)), F.col("file") + 1)
    return texts.encoded(found, texts.vocabulary(found), relations).select("h", "r", "t", part.alias("part"))


def _relations(spark: SparkSession, folder: str, files: list[str], order: str) -> DataFrame:
    return texts.vocabulary(texts.triples(texts.lines_of(spark, *[f"{folder.rstrip('/')}/{f}" for f in files]), order), "relation")


def transductive(spark: SparkSession, folder: str, order: str = "hrt", facts: bool = False) -> DataFrame:
    """``h, r, t, part`` of ``train.txt valid.txt test.txt``; with ``facts``, ``facts.txt`` counts as train."""
    files = {"train": "train.txt"} | ({"facts": "facts.txt"} if facts else {}) | {"valid": "valid.txt", "test": "test.txt"}
    relations = _relations(spark, folder, list(files.values()), order)
    found = _scope(spark, folder, files, relations, order, tuple(files))
    return found.withColumn("part", F.when(F.col("part") == "facts", "train").otherwise(F.col("part")))


def _two_scopes(train: DataFrame, inference: DataFrame) -> DataFrame:
    return train.withColumn("scope", F.lit("train")).unionByName(inference.withColumn("scope", F.lit("inference"))).select("scope", "part", "h", "r", "t")


def inductive(spark: SparkSession, folder: str, valid_on_inference: bool = False, order: str = "hrt") -> DataFrame:
    """``scope, part, h, r, t`` of four files: train graph, inference graph, validation and test triples.

    Entities are numbered anew in each scope, relations once. Validation belongs to the train scope, or
    with ``valid_on_inference`` to the other; a scope's entities grow by those of its queries.
    """
    files = {"train": "train_graph.txt", "inference": "inference_graph.txt", "valid": "validation.txt", "test": "test.txt"}
    relations = _relations(spark, folder, list(files.values()), order)
    first = {"graph": files["train"]} | ({} if valid_on_inference else {"valid": files["valid"]})
    second = {"graph": files["inference"]} | ({"valid": files["valid"]} if valid_on_inference else {}) | {"test": files["test"]}
    return _two_scopes(_scope(spark, folder, first, relations, order, ("graph",)), _scope(spark, folder, second, relations, order, ("graph",)))


def five_files(spark: SparkSession, folder: str, merge_valid_test: bool = True, order: str = "hrt") -> DataFrame:
    """``scope, part, h, r, t`` of ``train valid train_ind valid_ind test_ind``: both scopes number their own entities;
    with ``merge_valid_test`` the inductive validation triples are test queries too."""
    names = ["train.txt", "valid.txt", "train_ind.txt", "valid_ind.txt", "test_ind.txt"]
    relations = _relations(spark, folder, names, order)
    train = _scope(spark, folder, {"graph": names[0], "valid": names[1]}, relations, order, ("graph", "valid"))
    other = _scope(spark, folder, {"graph": names[2], "valid": names[3], "test": names[4]}, relations, order, ("graph", "valid", "test"))
    if merge_valid_test:
        other = other.withColumn("part", F.when(F.col("part") == "valid", "test").otherwise(F.col("part")))
    return _two_scopes(train, other)


def fact_files(spark: SparkSession, folder: str, order: str = "hrt") -> DataFrame:
    """``scope, part, h, r, t`` of ``train valid test_graph test_fact``: facts are queries over the test graph."""
    names = ["train.txt", "valid.txt", "test_graph.txt", "test_fact.txt"]
    relations = _relations(spark, folder, names, order)
    train = _scope(spark, folder, {"graph": names[0], "valid": names[1]}, relations, order, ("graph", "valid"))
    return _two_scopes(train, _scope(spark, folder, {"graph": names[2], "test": names[3]}, relations, order, ("graph", "test")))


def tabular(spark: SparkSession, folder: str, split: str, numerical: list[str], categorical: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, <features>, <target>, part`` and edges ``src, dst`` of CSV files: ``features.csv``, ``targets.csv`` and
    ``split_masks_<split>.csv`` by an index in the first column, ``edgelist.csv`` of two columns. A node in no mask has no part."""
    read = spark.read.option("header", True)

    def indexed(file: str) -> DataFrame:
        found = read.csv(f"{folder.rstrip('/')}/{file}")
        return found.withColumnRenamed(found.columns[0], "node").withColumn("node", F.col("node").cast("long"))

    features = indexed("features.csv").select("node", *[F.col(f"`{c}`").cast("double").alias(c) for c in numerical], *[F.col(f"`{c}`") for c in categorical])
    targets = indexed("targets.csv").select("node", F.col(f"`{target}`").cast("double").alias(target))
    masks = indexed(f"split_masks_{split}.csv")
    part = F.coalesce(*[F.when(F.lower(F.col(p)).isin("true", "1", "1.0"), p) for p in ("train", "val", "test")])
    edges = read.csv(f"{folder.rstrip('/')}/edgelist.csv")
    nodes = features.join(targets, "node", "left").join(masks.select("node", part.alias("part")), "node", "left")
    return nodes, edges.select(F.col(edges.columns[0]).cast("long").alias("src"), F.col(edges.columns[1]).cast("long").alias("dst"))


def masks_long(masks: DataFrame, key: str, column: str, n_nodes: int | None = None) -> DataFrame:
    """``node, split_idx, inside`` of a mask matrix whose rows are arrays. A row is a node, or, if the table has fewer rows
    than a row has entries, a split: then entries are nodes. ``n_nodes`` decides where it is given."""
    shape = masks.agg(F.count("*").alias("rows"), F.max(F.size(column)).alias("width")).first()
    by_nodes = shape["rows"] == n_nodes if n_nodes is not None else (shape["rows"] or 0) >= (shape["width"] or 0)
    flat = masks.select(F.col(key).alias("row"), F.posexplode(column).alias("at", "inside"))
    node, split = ("row", "at") if by_nodes else ("at", "row")
    return flat.select(F.col(node).cast("long").alias("node"), F.col(split).cast("long").alias("split_idx"), "inside")


def message_view(bundle: DataFrame, relations: int, split: str) -> tuple[DataFrame, DataFrame]:
    """Message edges ``src, rel, dst`` (visible triples both ways, turned ones as relation + ``relations``) and the queries
    ``h, r, t`` of a split, each once."""
    seen = bundle.where("visible").select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"))
    turned = seen.select(F.col("dst").alias("src"), (F.col("rel") + relations).alias("rel"), F.col("src").alias("dst"))
    return seen.unionByName(turned), bundle.where(F.col(f"is_{split}")).select("h", "r", "t").distinct()


def predicts_links(catalog: DataFrame) -> DataFrame:
    """``dataset, link_prediction`` of rows ``dataset, flag, has_visible, mask_len, n_edges``: the flag where it is set,
    else whether a visible mask and a split mask as long as the edges are there."""
    found = F.col("has_visible") & (F.col("mask_len") == F.col("n_edges"))
    return catalog.select("dataset", F.coalesce("flag", found, F.lit(False)).alias("link_prediction"))


def combined_runs(runs: list[DataFrame], key: str) -> DataFrame:
    """Run tables of different columns as one, a row a key: later tables win where they have a value."""
    numbered = [r.withColumn("__nth", F.lit(k)) for k, r in enumerate(runs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    values = [c for c in both.columns if c not in (key, "__nth")]
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__nth"))).alias(c) for c in values])
