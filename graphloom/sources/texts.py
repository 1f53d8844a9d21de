"""Readers of text formats as DataFrames of lines: triples, entity descriptions, logs, JSON metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines_of(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, line_no, value``: lines in file order. A file's lines are numbered by their offset in it."""
    out = None
    for k, path in enumerate(paths):
        part = spark.read.text(path).select(F.lit(k).alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def triples(lines: DataFrame, order: str = "hrt", delimiter: str | None = None) -> DataFrame:
    """Lines of exactly three tokens as ``file, line_no, h, r, t`` tokens; others are skipped."""
    parts = F.split(F.trim("value"), r"\s+" if delimiter is None else delimiter)
    place = {c: order.index(c) for c in "hrt"}
    cut = lines.withColumn("p", parts).where((F.size("p") == 3) & (F.trim("value") != ""))
    return cut.select("file", "line_no", *[F.trim(F.col("p")[place[c]]).alias(c) for c in "hrt"])


def vocabulary(found: DataFrame, which: str = "entity") -> DataFrame:
    """``token, id`` in order of first sight: by file, line, and head before tail; by token where lines share a number."""
    if which == "entity":
        seen = found.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("h").alias("token")), F.struct(F.lit(1).alias("side"), F.col("t").alias("token")))).alias("x"), "file", "line_no")
    else:
        seen = found.select(F.struct(F.lit(0).alias("side"), F.col("r").alias("token")).alias("x"), "file", "line_no")
    first = seen.groupBy(F.col("x.token").alias("token")).agg(F.min(F.struct("file", "line_no", "x.side")).alias("at"))
    numbered = first.select("token", "at.file", (F.col("at.line_no") * 2 + F.col("at.side")).alias("place"))
    # ids come by ranges of places, file by file
    from ..operators.scans import dense_ids

    whole = numbered.select("token", (F.col("file").cast("long") * F.lit(1 << 58) + F.col("place")).alias("key"))
    return dense_ids(whole, "key", "id", "token").select("token", "id")


def encoded(found: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    met = found.join(entities.toDF("h", "hi"), "h").join(relations.toDF("r", "ri"), "r").join(entities.toDF("t", "ti"), "t")
    return met.select("file", F.col("hi").alias("h"), F.col("ri").alias("r"), F.col("ti").alias("t"))


def entity_texts(lines: DataFrame) -> DataFrame:
    """``offset<TAB>lemma, gloss`` (else the first space) as ``offset, text`` with 'lemma: gloss'."""
    tab = F.instr("value", "\t") > 0
    parts = F.when(tab, F.split("value", "\t", 2)).otherwise(F.split("value", " ", 2))
    cut = lines.where(F.trim("value") != "").select(F.trim(parts[0]).alias("offset"), F.trim(F.element_at(parts, 2)).alias("body"))
    lemma, gloss = F.trim(F.substring_index("body", ",", 1)), F.trim(F.expr("substring(body, instr(body, ',') + 1)"))
    return cut.select("offset", F.when(F.instr("body", ",") > 0, F.concat(lemma, F.lit(": "), gloss)).otherwise(F.col("body")).alias("text"))


def log_metrics(lines: DataFrame) -> DataFrame:
    """``dataset, metric, value`` of lines '[eval_only] <dataset> done: k=v, ...'; the last line of a dataset counts."""
    pattern = r"\[eval_only\] (\S+) done: (.*)$"
    hit = lines.where(F.col("value").rlike(pattern)).select("file", "line_no", F.regexp_extract("value", pattern, 1).alias("dataset"), F.regexp_extract("value", pattern, 2).alias("body"))
    last = hit.groupBy("dataset").agg(F.max_by("body", F.struct("file", "line_no")).alias("body"))
    pairs = last.select("dataset", F.explode(F.split("body", r",\s*")).alias("kv")).where(F.instr("kv", "=") > 0)
    return pairs.select("dataset", F.trim(F.substring_index("kv", "=", 1)).alias("metric"), F.expr("try_cast(substring_index(kv, '=', -1) AS double)").alias("value"))


METRICS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))


def json_metrics(payload: Column) -> Column:
    """``metrics: {dataset: {metric: number or {mean, std}}}`` as an array of (dataset, metric, value);
    a pair gives ``metric`` and ``metric_std``."""
    parsed = F.from_json(F.get_json_object(payload, "$.metrics"), METRICS)
    flat = F.flatten(F.transform(F.map_entries(parsed), lambda d: F.transform(F.map_entries(d["value"]), lambda m: F.struct(d["key"].alias("dataset"), m["key"].alias("metric"), m["value"].alias("raw")))))
    both = F.flatten(
        F.transform(
            flat,
            lambda x: F.when(
                x["raw"].startswith("{"),
                F.array(
                    F.struct(x["dataset"].alias("dataset"), x["metric"].alias("metric"), F.get_json_object(x["raw"], "$.mean").cast("double").alias("value")),
                    F.struct(x["dataset"].alias("dataset"), F.concat(x["metric"], F.lit("_std")).alias("metric"), F.get_json_object(x["raw"], "$.std").cast("double").alias("value")),
                ),
            ).otherwise(F.array(F.struct(x["dataset"].alias("dataset"), x["metric"].alias("metric"), F.when(~x["raw"].startswith("{"), x["raw"]).cast("double").alias("value")))),
        )
    )
    return both


def coo(matrix: DataFrame, offset: int = 0) -> DataFrame:
    """Entries ``row, col, val`` that aren't zero as ``h, r, t`` with relation 0 and shifted tails."""
    return matrix.where("val <> 0").select(F.col("row").alias("h"), F.lit(0).alias("r"), (F.col("col") + offset).alias("t")).distinct()


#: Names that stand for groups of datasets.
def expand_aliases(keys: list[str], groups: dict[str, list[str]]) -> list[str]:
    """Keys in order, group names replaced by their members, each once; case doesn't matter."""
    lower = {k.lower(): v for k, v in groups.items()}
    return list(dict.fromkeys(x for k in keys for x in lower.get(k.lower(), [k])))


def parse_key(key: str, versions: dict[str, list[str]]) -> tuple[str, str | None]:
    """``NAME[:version]`` against the supported versions (names by any case)."""
    name, _, version = key.partition(":")
    known = {k.lower(): k for k in versions}
    if name.lower() not in known:
        raise KeyError(f"no dataset named {name}")
    real = known[name.lower()]
    if version and version not in versions[real]:
        raise ValueError(f"{real} has no version {version}")
    return real, version or None
