"""Helpers the text operators share: shared-folder tables, row keys, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, written  # noqa: F401

#: Bytes of a batch as Spark sends it, and of a slice that a function gets.
BATCH_BYTES, MOST_BYTES = 4 << 20, 1 << 18
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once an application: they need not
    lie where workers start, nor be installed there."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="graphloom-"), f"{root.name}.zip"))
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(Path(root.name) / file.relative_to(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def prepared(spark: SparkSession) -> None:
    """The sources shipped, and Arrow batches held to BATCH_BYTES (a setting of the session)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once per row and names it inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(list of columns as Python lists) -> dict`` over record batches.

    ``fn`` gets a ``pyarrow.RecordBatch`` and returns a dict of columns. Spark's batches
    are held to BATCH_BYTES and ``fn``'s to MOST_BYTES (one row at least), so a worker's
    memory doesn't follow the lengths of the texts that happen to lie side by side.
    """
    prepared(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in split_batch(batch):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, most_bytes: int = MOST_BYTES):
    """Slices of a batch of about ``most_bytes`` each, one row at least."""
    if batch.num_rows <= 1 or batch.nbytes <= most_bytes:
        yield batch
        return
    half = batch.num_rows // 2
    yield from split_batch(batch.slice(0, half), most_bytes)
    yield from split_batch(batch.slice(half), most_bytes)
