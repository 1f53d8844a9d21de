"""Line dedup by winnowing: later copies of passages of 50 words or more go.

A window is the shortest run of consecutive lines (those with a word) that
reaches ``words`` words; one long line is a window of its own. Each window's
smallest line hash is its fingerprint. Equal windows choose equal fingerprints,
so every repeated passage is guaranteed to show up among fingerprints that stand
at two positions or more. Those positions are joined; around them the windows to
both sides are compared by content, and the union of the windows seen earlier is
deleted. The earliest occurrence, by id and then line, stays.

These windows extend a match from its first line up to the end of the last window that
fits, which would leave up to ``words - 1`` words behind. ``extend`` (the default) adds
the shortest runs that end at a line, which extend it to the other side: every line of
a repeated run lies in a window of one of the two kinds within the run, so that their
union is the maximal run. Positions are matched by the windows' content, not pair by
pair: a passage that stands in a third of all documents never meets itself in pairs.

All of it is DataFrame code. Rows are shuffled as line hashes (by document), as
sparse fingerprints and as the few windows around repeated ones, and once as
texts, to apply the deletions. A passage in a third of all documents meets one
``min`` with partial aggregation and a join that Spark may split, never all pairs.

Defined results for odd rows: a null text stays null; an empty text, or one
without a passage, is unchanged; null ids come first in the order; rows with the
same id and text are one document, treated alike, and all stay; other columns
pass through unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, written

#: Words that make a passage.
WORDS = 50

_KEY = ["__id", "__text_hash"]
_LINES = (
    "filter(transform(split({t}, '\\n'), (l, i) -> struct(i AS pos, xxhash64(l) AS h, xxhash64(l, 1) AS h2, "
    "size(filter(split(l, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')) AS w)), x -> x.w > 0)"
)


def windows(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, extend: bool = True) -> DataFrame:
    """All passages' windows: document, first and last line, fingerprint with its line, and content hashes.

    ``extend`` adds the shortest runs that end at a line, where they aren't windows already.
    """
    lines = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text_hash"), F.expr(_LINES.format(t=f"`{text_col}`")).alias("lines"))
    lines = lines.where("size(lines) > 0").groupBy(*_KEY).agg(F.first("lines").alias("lines"))
    flat = lines.select(*_KEY, F.explode("lines").alias("x")).select(*_KEY, "x.*")
    by_line = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("before", F.coalesce(F.sum("w").over(by_line), F.lit(0)))
    ahead = Window.partitionBy(*_KEY).orderBy("before").rangeBetween(0, words - 1)

    def window(over, *more):
        return [
            F.min("pos").over(over).alias("pos"),
            F.max("pos").over(over).alias("last"),
            F.min(F.struct("h", "pos")).over(over).alias("fp"),
            F.xxhash64(F.collect_list("h").over(over)).alias("w1"),
            F.expr("bit_xor(h2)").over(over).alias("w2"),
            *more,
        ]

    if extend:
        placed = placed.withColumn("upto", F.col("before") + F.col("w"))
        behind = Window.partitionBy(*_KEY).orderBy("upto").rangeBetween(1 - words, 0)
        ways = [
            F.struct(*window(ahead, (F.max("upto").over(ahead) - F.col("before")).alias("total"))),
            # without its last line such a run still has the words, or it is a window of its first line
            F.struct(*window(behind, (F.col("before") - F.min("before").over(behind)).alias("total"))),
        ]
        found = placed.select(*_KEY, *[x.alias(f"way{k}") for k, x in enumerate(ways)]).select(*_KEY, F.explode(F.array("way0", "way1")).alias("x")).select(*_KEY, "x.*")
    else:
        found = placed.select(*_KEY, *window(ahead, (F.max(F.col("before") + F.col("w")).over(ahead) - F.col("before")).alias("total")))
    return found.where(F.col("total") >= words).select(*_KEY, "pos", "last", F.col("fp.h").alias("fp"), F.col("fp.pos").alias("fp_pos"), "w1", "w2")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, extend: bool = True) -> DataFrame:
    """The windows that occur earlier: ``__id, __text_hash, pos, last``."""
    found = written(windows(docs, id_col, text_col, words, extend), "line-windows")
    place = F.struct(*_KEY, "fp_pos")
    shared = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp")
    near = found.join(written(shared, "line-fingerprints"), "fp", "left_semi")
    near = written(near.select(*_KEY, "pos", "last", "w1", "w2"), "line-candidates")
    firsts = near.groupBy("w1", "w2").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("w1", "w2", "first"), "line-firsts")
    return near.join(firsts, ["w1", "w2"]).where(F.struct(*_KEY, "pos") > F.col("first")).select(*_KEY, "pos", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, count_cols: bool = False, extend: bool = True) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, unless not ``extend`` up to their last lines.

    ``count_cols`` adds ``n_lines`` (of the text before) and ``n_removed``.
    """
    gone = repeated(docs, id_col, text_col, words, extend).groupBy(*_KEY).agg(F.collect_set(F.struct("pos", "last")).alias("__runs"))
    gone = gone.withColumn("__gone", F.expr("array_distinct(flatten(transform(__runs, r -> sequence(r.pos, r.last))))")).drop("__runs")
    gone = gone.select(F.col("__id").alias("__gone_id"), F.col("__text_hash").alias("__gone_hash"), "__gone")
    # a join that keeps the texts unsorted: the deletions are the hashed side
    text_hash, removed = free_name(docs, "__text_hash"), free_name(docs, "__gone")
    gone = gone.select(F.col("__gone_id").alias(free_name(docs, "__gone_id")), F.col("__gone_hash").alias(free_name(docs, "__gone_hash")), F.col("__gone").alias(removed))
    keyed = docs.withColumn(text_hash, F.xxhash64(text_col))
    met = keyed.join(gone.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(gone[gone.columns[0]]) & (F.col(text_hash) == gone[gone.columns[1]]), "left")
    parts = f"split(`{text_col}`, '\\n')"
    kept = f"element_at(transform(array({parts}), p -> array_join(transform(array_except(sequence(0, size(p) - 1), {removed}), i -> p[i]), '\\n')), 1)"
    text = F.expr(f"IF({removed} IS NULL, `{text_col}`, {kept})")
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_cols:
        out += [F.expr(f"IF(`{text_col}` IS NULL, 0, size({parts}))").cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed")]
    return met.select(*out)
