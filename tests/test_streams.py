"""The stream of best values: arrivals against a plain loop, and restarts."""

import random

from graphloom.operators import scans
from graphloom.streaming import running


def test_arrivals_and_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "BUCKET", 8)
    rng = random.Random(1)
    rows = [(rng.choice("aab"), k, rng.choice([None, rng.random()])) for k in range(90)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(part):
        spark.createDataFrame(part, "run string, epoch long, value double").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("run string, epoch long, value double").option("maxFilesPerTrigger", 1).parquet(source)
        running.best_so_far(stream, out, checkpoint).awaitTermination()
        return spark.read.parquet(f"{out}/rows").collect()

    def want(n):
        best, found = {}, {}
        for r, k, v in rows[:n]:
            best[r] = max((x for x in (best.get(r), v) if x is not None), default=None)
            found[r, k] = best[r]
        return found

    arrive(rows[:20]), arrive(rows[20:50])
    assert {(r.run, r.epoch): r.best for r in run()} == want(50)
    arrive(rows[50:])
    for _ in range(2):  # the second time nothing is new
        got = run()
        assert len(got) == 90 and {(r.run, r.epoch): r.best for r in got} == want(90)
