"""Tables between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor and the driver reach: ``spark.checkpoint.dir``.

    Only a local master (tests) may leave it unset; then a folder below the
    system temp folder is made once and kept for the application.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="graphloom-")
    return "file://" + _OWN[sc.applicationId]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and a lost
    executor costs a re-read, not a recomputation. ``options`` go to the writer."""
    path = fresh_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
