"""Writers: versioned caches, metric files, fixed-order CSV, text tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_or_build(spark: SparkSession, path: str, params: dict, build) -> DataFrame:
    """The table at ``path`` if it was built with ``params``, else built anew. The parameters lie beside
    it as a one-row table, written last, so a half-written table is never read."""
    want = json.dumps(params, sort_keys=True)
    meta = f"{path.rstrip('/')}_meta"
    try:
        if spark.read.text(meta).first()[0] == want:
            return spark.read.parquet(path)
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(meta)
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        metrics.write.mode("overwrite").json(path)
    else:
        metrics.write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True)


def fixed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns in order, missing ones empty."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def text_table(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """One padded line a row; null and NaN show as '-'."""
    cells = [F.rpad(F.when(F.col(c).isNull() | (F.col(c).cast("string") == "NaN"), "-").otherwise(F.col(c).cast("string")), w, " ") for c, w in columns.items()]
    return rows.select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))
