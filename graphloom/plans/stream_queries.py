"""Queries of streams and their seeded mixes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators.scans import numbered_within
from ..shared import fresh_path
from ..streaming import running as RN
from .registry import query

HALF = draw_sql("'st5|3|' || id")


def _stream(t):
    folder = t.folder if "://" in t.folder else "file://" + os.path.abspath(t.folder)
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


@query("st13_running_metrics", "SELECT event_type AS dataset, count(*) AS n, round(sum(value), 4) AS total, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY event_type")
def _(t):
    out = RN.drained(RN.running_metrics(_stream(t)), f"running_{uuid.uuid4().hex}", fresh_path(t.spark, "stream"))
    return out.withColumn("total", F.round("total", 4))


@query("st8_watched_files", "WITH f AS (SELECT 'model_seed' || user_id % 3 || '_epoch' || event_id || '.pt' AS path, (user_id % 3)::INT AS seed, event_id::INT AS epoch, event_id % 100 AS age, event_id % 5 AS size FROM events) SELECT path, seed, epoch, row_number() OVER (PARTITION BY seed ORDER BY epoch) AS turn FROM f WHERE (age >= 60 OR size = 1) AND epoch % 7 <> 0")
def _(t):
    files = t.events.select(F.concat(F.lit("model_seed"), (F.col("user_id") % 3), F.lit("_epoch"), F.col("event_id"), F.lit(".pt")).alias("path"), (F.col("event_id") % 100).alias("age_s"), (F.col("event_id") % 5).alias("size"), F.lit(1).alias("last_size"))
    seen = t.events.where("event_id % 7 = 0").select(F.concat(F.lit("model_seed"), (F.col("user_id") % 3), F.lit("_epoch"), F.col("event_id"), F.lit(".pt")).alias("path"))
    return RN.watch(files, seen)


@query("st9_best_so_far", "SELECT user_id AS run, event_id AS epoch, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events")
def _(t):
    """All events in three arrivals, by ranges of their ids, through the stream."""
    source, out = fresh_path(t.spark, "arrivals"), fresh_path(t.spark, "best")
    events = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), "value")
    cuts = events.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()  # one row
    third = F.floor((F.col("epoch") - cuts["a"]) * 3 / F.lit(cuts["b"] - cuts["a"] + 1))
    for k in range(3):
        events.where(third == k).coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    RN.best_so_far(stream, out, fresh_path(t.spark, "stream")).awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("run", "epoch", "best")


@query("st10_resumed_batches", "WITH p AS (SELECT user_id % 4 AS worker, count(*) AS done FROM events GROUP BY 1) SELECT p_partkey AS batch FROM part WHERE p_partkey >= (SELECT min(done) % 500 FROM p)")
def _(t):
    want = RN.fingerprint({"batch": 1})
    progress = t.events.groupBy((F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("done")).withColumn("fingerprint", F.lit(want))
    done = RN.resume_point(progress, want) % 500
    return RN.resumed(t.part.select(F.col("p_partkey").alias("batch")), done)


@query("st5_task_coins", f"SELECT id AS step, {HALF} / 4294967296.0::DOUBLE < 0.4 AS heads FROM (SELECT row_number() OVER () - 1 AS id FROM events) AS r")
def _(t):
    return RN.coins(t.spark, 3, t.events.count(), 0.4, "st5|")


@query("st6_mixed_stream", f"WITH f AS (SELECT id AS step, {HALF} / 4294967296.0::DOUBLE < 0.4 AS heads FROM (SELECT row_number() OVER () - 1 AS id FROM events) AS r), n AS (SELECT *, row_number() OVER (PARTITION BY heads ORDER BY step) - 1 AS nth FROM f), i AS (SELECT event_type = 'click' AS heads, row_number() OVER (PARTITION BY event_type = 'click' ORDER BY event_id) - 1 AS nth, 'e' || event_id AS item FROM events) SELECT step, heads, item FROM n JOIN i USING (heads, nth)")
def _(t):
    """Clicks and all other events, each in order of their ids, as many as there are."""
    items = t.events.select("event_id", (F.col("event_type") == "click").cast("int").alias("heads"), F.concat(F.lit("e"), "event_id").alias("item"))
    numbered = numbered_within(items, "heads", "event_id", "nth")
    a, b = (numbered.where(f"heads = {k}").select("nth", "item") for k in (1, 0))
    return RN.mixed(a, b, RN.coins(t.spark, 3, t.events.count(), 0.4, "st5|"))


@query("st7_weighted_choice", f"WITH w AS (SELECT event_type AS name, count(*) AS w FROM events GROUP BY 1), b AS (SELECT name, (sum(w) OVER (ORDER BY name) - w) / sum(w) OVER ()::DOUBLE AS lo, sum(w) OVER (ORDER BY name) / sum(w) OVER ()::DOUBLE AS hi FROM w) SELECT id AS step, name FROM (SELECT row_number() OVER () - 1 AS id FROM events) AS r JOIN b ON {draw_sql("'st7|' || id")} / 4294967296.0::DOUBLE >= lo AND {draw_sql("'st7|' || id")} / 4294967296.0::DOUBLE < hi WHERE id % 2 = 1")
def _(t):
    weights = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("w"))
    return RN.weighted_choice(t.spark.range(t.events.count()).toDF("step"), weights, "st7|", 1, 2)
