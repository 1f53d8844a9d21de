"""Graphs derived from the order tables: part co-orders, part-supplier relations, customer-part purchases."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, draw_sql


def _split(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("split", F.when(F.col("fo") % 5 < 3, "train").when(F.col("fo") % 5 == 3, "val").otherwise("test"))


def both_ways(pairs: DataFrame, splits: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst``, both directions of ``u, v`` of the given splits."""
    pairs = pairs.where(F.col("split").isin(*splits)) if splits else pairs
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


class Tables:
    """The tables of a folder, and the graphs made of them. Reads are lazy; nothing is kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def part_pairs(self) -> DataFrame:
        """``u < v, fo, split``: parts of one order (all pairs of every order), the first such order, the split it decides."""
        lines = self.lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("p"))
        met = lines.join(lines.withColumnRenamed("p", "q"), "ok").where("p < q")
        return _split(met.groupBy(F.col("p").alias("u"), F.col("q").alias("v")).agg(F.min("ok").alias("fo")))

    def next_pairs(self) -> DataFrame:
        """The same columns for parts of neighbouring lines only: a thinner graph, for paths of four edges and more."""
        following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        lines = self.lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("p"), following.alias("q")).where("p <> q")
        return _split(lines.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.min("ok").alias("fo")))

    def next_edges(self, *splits: str) -> DataFrame:
        return both_ways(self.next_pairs(), splits)

    def hub_nodes(self) -> DataFrame:
        """``node``: nations, and customers shifted by their number."""
        n = self.nation.agg(F.count("*").alias("n"))  # one row
        customers = self.customer.crossJoin(F.broadcast(n)).select((F.col("c_custkey") + F.col("n")).alias("node"))
        return self.nation.select(F.col("n_nationkey").alias("node")).unionByName(customers)

    def hub_edges(self) -> DataFrame:
        """``src, dst``, both ways: a customer and its nation, but customers in debt have no edge, and those of the segment
        MACHINERY are tied to the customer before them instead. Hubs, isolated nodes, chains and many components."""
        n = self.nation.agg(F.count("*").alias("n"))  # one row
        c = self.customer.where("c_acctbal >= 0").crossJoin(F.broadcast(n))
        own = F.col("c_custkey") + F.col("n")
        other = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") > 0), own - 1).otherwise(F.col("c_nationkey"))
        return both_ways(c.select(other.alias("u"), own.alias("v")))

    def part_edges(self, *splits: str) -> DataFrame:
        """Both directions, ``src, dst``, of the given splits (all without any)."""
        return both_ways(self.part_pairs(), splits)

    def part_nodes(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("node"))

    def triples(self) -> DataFrame:
        """``h, r, t, split``: part, return flag and line status, supplier (shifted by the number of parts)."""
        codes = F.create_map(*[F.lit(x) for k, name in enumerate(("AF", "AO", "NF", "NO", "RF", "RO")) for x in (name, k)])
        n = self.part.agg(F.count("*").alias("n"))
        rows = self.lineitem.crossJoin(F.broadcast(n))  # one row
        made = rows.select(
            F.col("l_partkey").alias("h"), codes[F.concat("l_returnflag", "l_linestatus")].cast("int").alias("r"), (F.col("l_suppkey") + F.col("n")).alias("t")
        ).distinct()
        part = draw("1:", F.col("h"), ":", F.col("r"), ":", F.col("t")) % 10
        return made.withColumn("split", F.when(part < 8, "train").when(part == 8, "val").otherwise("test"))

    def purchases(self) -> DataFrame:
        """``src, dst``: customer and part (shifted by the number of customers)."""
        n = self.customer.agg(F.count("*").alias("n"))
        met = self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        return met.crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + F.col("n")).alias("dst")).distinct()

    def labels_of_parts(self) -> DataFrame:
        """``node, label`` by type; no label where the size is over 45."""
        types = [r[0] for r in self.part.select("p_type").distinct().orderBy("p_type").collect()]  # the type domain
        codes = F.create_map(*[F.lit(x) for k, t in enumerate(types) for x in (t, k)])
        return self.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") <= 45, codes[F.col("p_type")]).cast("int").alias("label"))

    def split_of_parts(self) -> DataFrame:
        part = draw("5:", F.col("p_partkey")) % 10
        return self.part.select(F.col("p_partkey").alias("node"), F.when(part == 0, "train").when(part <= 2, "val").otherwise("test").alias("part"))

    def runs(self) -> DataFrame:
        """Metric rows of the event stream: ``dataset, seed, split_idx, metric, value``."""
        return self.events.select(
            F.col("event_type").alias("dataset"),
            (F.col("user_id") % 3).cast("int").alias("seed"),
            (F.col("user_id") % 5).cast("int").alias("split_idx"),
            F.when(F.col("event_id") % 2 == 0, "mrr").otherwise("accuracy").alias("metric"),
            "value",
        )


#: The same graphs as common table expressions for DuckDB.
_SPLIT = "CASE WHEN min(ok) % 5 < 3 THEN 'train' WHEN min(ok) % 5 = 3 THEN 'val' ELSE 'test' END AS split"
_ENDS = """edges AS (SELECT u AS src, v AS dst FROM pairs UNION ALL SELECT v, u FROM pairs),
tedges AS (SELECT u AS src, v AS dst FROM pairs WHERE split = 'train' UNION ALL SELECT v, u FROM pairs WHERE split = 'train'),
xedges AS (SELECT u AS src, v AS dst FROM pairs WHERE split = 'test' UNION ALL SELECT v, u FROM pairs WHERE split = 'test')"""
PART = f"""pairs AS (SELECT u, v, min(ok) AS fo, {_SPLIT} FROM (SELECT a.l_orderkey AS ok, a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
  GROUP BY u, v), {_ENDS}"""
NEXT = f"""lines AS (SELECT l_orderkey AS ok, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS q FROM lineitem),
pairs AS (SELECT least(p, q) AS u, greatest(p, q) AS v, min(ok) AS fo, {_SPLIT} FROM lines WHERE p <> q GROUP BY least(p, q), greatest(p, q)), {_ENDS}"""
HUB = """hnodes AS (SELECT n_nationkey AS node FROM nation UNION ALL SELECT c_custkey + (SELECT count(*) FROM nation) FROM customer),
hpairs AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey > 0 THEN c_custkey - 1 + (SELECT count(*) FROM nation) ELSE c_nationkey END AS u, c_custkey + (SELECT count(*) FROM nation) AS v FROM customer WHERE c_acctbal >= 0),
hedges AS (SELECT u AS src, v AS dst FROM hpairs UNION ALL SELECT v, u FROM hpairs)"""
KG = f"""kg0 AS (SELECT DISTINCT l_partkey AS h, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS r,
  l_suppkey + (SELECT count(*) FROM part) AS t FROM lineitem),
kg AS (SELECT *, CASE WHEN {draw_sql("'1:' || h || ':' || r || ':' || t")} % 10 < 8 THEN 'train' WHEN {draw_sql("'1:' || h || ':' || r || ':' || t")} % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM kg0)"""
BIP = """bip AS (SELECT DISTINCT o_custkey AS src, l_partkey + (SELECT count(*) FROM customer) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
LABEL = f"""types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part)),
lab AS (SELECT p_partkey AS node, CASE WHEN p_size <= 45 THEN k END AS label FROM part JOIN types USING (p_type)),
nsplit AS (SELECT p_partkey AS node, CASE WHEN {draw_sql("'5:' || p_partkey")} % 10 = 0 THEN 'train' WHEN {draw_sql("'5:' || p_partkey")} % 10 <= 2 THEN 'val' ELSE 'test' END AS part FROM part)"""
RUNS = """runs AS (SELECT event_type AS dataset, user_id % 3 AS seed, user_id % 5 AS split_idx, CASE WHEN event_id % 2 = 0 THEN 'mrr' ELSE 'accuracy' END AS metric, value FROM events)"""
