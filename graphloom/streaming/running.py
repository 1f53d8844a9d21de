"""Streams over files: running metrics, watched folders, resumable batches, seeded mixes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.draws import uniform
from ..operators.scans import prefix_max_within


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, schema taken from what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def running_metrics(events: DataFrame) -> DataFrame:
    """Count, sum and best value of each dataset so far (update or complete mode): merges partial states."""
    return events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


def windowed_metrics(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An addition to batch roll-ups: tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def best_so_far(stream: DataFrame, path: str, checkpoint: str):
    """Start a stream over ``run, epoch, value`` that keeps each run's best value so far, and return its query.

    Each arrival is one version of two tables below ``path``: ``rows`` (``run, epoch, value, best``) and ``best`` (a row a run: what
    all versions up to this one have seen). Version k comes from the arrival and version k - 1 alone and overwrites
    what an attempt before it may have left, so that a restart from the checkpoint repeats and loses nothing. A row that comes
    late counts from its arrival on. Runs of many rows are taken by ranges of epochs.
    """
    spark = stream.sparkSession
    kept = StructType([f for f in stream.schema if f.name in ("run", "value")])

    def arrive(batch: DataFrame, version: int) -> None:
        before = spark.read.schema(kept).parquet(f"{path}/best/version={version - 1}") if version else spark.createDataFrame([], kept)
        before = before.select("run", F.col("value").alias("__before"))
        own = prefix_max_within(batch.select("run", "epoch", "value"), "run", "epoch", "value", "best")
        rows = own.join(before, "run", "left").select("run", "epoch", "value", F.greatest("best", "__before").alias("best"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/version={version}")
        both = batch.select("run", "value").unionByName(before.withColumnRenamed("__before", "value"))
        both.groupBy("run").agg(F.max("value").alias("value")).write.mode("overwrite").parquet(f"{path}/best/version={version}")

    return stream.writeStream.foreachBatch(arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table (an in-memory sink: for
    aggregates of bounded size)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def watch(files: DataFrame, seen: DataFrame) -> DataFrame:
    """New stable checkpoints of ``files(path, age_s, size, last_size)``: 'model_seed<S>_epoch<E>.pt', a minute old
    or of the same size twice, not in ``seen(path)``; ordered round-robin over seeds by ``turn``."""
    pattern = r"model_seed(\d+)_epoch(\d+)\.pt$"
    named = files.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).cast("int").alias("seed"), F.regexp_extract("path", pattern, 2).cast("int").alias("epoch"), ((F.col("age_s") >= 60) | (F.col("size") == F.col("last_size"))).alias("stable"))
    fresh = named.where("stable").join(seen.select("path"), "path", "left_anti")
    return fresh.select("path", "seed", "epoch", F.row_number().over(Window.partitionBy("seed").orderBy("epoch")).alias("turn"))


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def resume_point(progress: DataFrame, want: str) -> int:
    """The batch that all workers have finished, of ``progress(worker, fingerprint, done)``; a differing
    fingerprint refuses to resume."""
    row = progress.agg(F.min("done").alias("done"), F.count_if(F.col("fingerprint") != want).alias("other")).first()  # one row
    if row["other"]:
        raise ValueError("the saved run has other settings")
    return row["done"] or 0


def resumed(batches: DataFrame, done: int) -> DataFrame:
    """Batches after the finished prefix."""
    return batches.where(F.col("batch") >= done)


def coins(spark: SparkSession, epoch: int, steps: int, p: float, seed: str) -> DataFrame:
    """``step, heads``: a seeded Bernoulli sequence, the same for all ranks of an epoch."""
    return spark.range(steps).toDF("step").withColumn("heads", uniform(seed, epoch, "|", F.col("step")) < p)


def mixed(a: DataFrame, b: DataFrame, flips: DataFrame) -> DataFrame:
    """Two sources interleaved by the coin: step k takes the next item of a on heads, of b on tails.
    The sources are ``item`` with ``nth`` from 0; each side gives exactly as many as the coin asks."""
    turn = Window.partitionBy("heads").orderBy("step")
    asked = flips.withColumn("nth", F.row_number().over(turn) - 1)
    both = a.select(F.lit(True).alias("heads"), "nth", "item").unionByName(b.select(F.lit(False).alias("heads"), "nth", "item"))
    return asked.join(both, ["heads", "nth"]).select("step", "heads", "item")


def weighted_choice(steps: DataFrame, weights: DataFrame, seed: str, rank: int = 0, world: int = 1) -> DataFrame:
    """``step, name``: a graph for each step by weight from one shared sequence; a rank takes every ``world``-th step."""
    total = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)  # a row a graph
    upto = weights.select("name", F.sum("w").over(total).alias("hi"), F.sum("w").over(Window.partitionBy()).alias("all"))
    bounds = upto.select("name", (F.coalesce(F.lag("hi").over(Window.orderBy("name")), F.lit(0)) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    drawn = steps.withColumn("x", uniform(seed, F.col("step"))).where(F.col("step") % world == rank)
    return drawn.join(F.broadcast(bounds), (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("step", "name")
