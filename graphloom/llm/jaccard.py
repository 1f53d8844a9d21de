"""N-gram Jaccard self-join by MinHash banding, verified on full shingle sets.

Texts with the same words form one class; classes are compared. Bands and rows
follow from the threshold and the target recall. Class ids are shuffled on band
hashes; only buckets with two classes or more go on. There, in blocks of bounded
size, whole sketches are compared and tie similar classes into families: a
spanning forest leaves each block pair, never its pairs. Every class's full
shingle set then travels once to its family, where, block by block, all pairs are
verified exactly by bit sets. Links are counted in place; again only a spanning
forest leaves. So rows grow with classes, though a family's links may be many.

Defined results for odd rows: null texts, and texts without a word, are classes
of their own row and have no links; texts under five words have one shingle, all
their words; null ids sort last when a representative is chosen and are returned;
rows with the same id and text are copies of one another; other columns aren't
read by the join; an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import arrow_map, free_name, written
from .components import components

THRESHOLD, RECALL, ROWS = 0.8, 0.9999, 4
#: Members of a block, and shingles of a block where sets are compared.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Values whose bits are compared at once.
COLUMNS = 1 << 14


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair at the threshold with the target recall."""
    bands, missed = 1, 1 - threshold**rows
    while missed**bands > 1 - recall:
        bands += 1
    return bands


def least_agreement(hashes: int, threshold: float, missed: float = 1e-6) -> int:
    """How many of ``hashes`` minima a pair at the threshold shares at least, but for a chance ``missed``."""
    below = 0.0
    for k in range(hashes + 1):
        below += comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > missed:
            return k
    return hashes


def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(42))
    return rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def sketches(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash minima (unsigned 32-bit) of each text that has shingles."""
    full = counts > 0
    begin = (np.cumsum(counts) - counts)[full]
    out = np.empty((int(full.sum()), hashes), np.uint32)
    a, b = _permutations(hashes)
    if len(out):
        for j in range(hashes):
            out[:, j] = np.minimum.reduceat(((values * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, hashes: int) -> DataFrame:
    """id, text hash (null-safe row key), class ``c`` (16 bytes, null without words) and ``sketch``."""

    def run(batch: pa.RecordBatch) -> dict:
        words, counts = S.word_hashes([t or "" for t in batch.column(2).to_pylist()])
        grams, n = S.shingle_hashes(words, counts)
        rows = iter(sketches(grams, n, hashes))
        full = (counts > 0).tolist()
        return {
            "id": batch.column(0),
            "text_hash": batch.column(1),
            "c": [d if f else None for d, f in zip(S.digests(words, counts), full, strict=True)],
            "sketch": [next(rows).astype("<u4").tobytes() if f else None for f in full],
        }

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, text_hash long, c binary, sketch binary")


def _roots(n: int):
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    return root, find


def _runs(batches, n_keys: int):
    """Whole runs of equal keys (the first ``n_keys`` columns) over sorted batches, as tables of the rest."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_pylist() for k in range(n_keys)]
        rows = list(zip(*keys, strict=True))
        at = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[at]:
                if held and rows[at] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = rows[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield key, pa.Table.from_batches(held)


def _in_blocks(members: DataFrame, group: str, weight: str, most: int) -> DataFrame:
    """``members`` with ``bi, bj`` and ``own``: each row once for every pair of blocks that holds its own.

    ``members`` has ``size`` (rows of the group) and ``heavy`` (its summed weight). A group within the
    limits is one block; larger ones are dealt by hash.
    """
    blocks = f"cast(greatest(ceil(size / {BLOCK}), ceil(heavy / {most})) as int)"
    dealt = members.withColumn("nb", F.expr(blocks)).withColumn("own", F.expr("cast(pmod(xxhash64(c), nb) as int)"))
    pairs = "IF(nb = 1, array(struct(0 AS bi, 0 AS bj)), transform(sequence(0, nb - 1), k -> struct(least(own, k) AS bi, greatest(own, k) AS bj)))"
    return dealt.withColumn("pair", F.explode(F.expr(pairs))).select(group, "pair.bi", "pair.bj", "own", *[c for c in members.columns if c not in (group, "size", "heavy")])


def families(classes: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Edges ``a, b`` that tie classes with similar sketches and a shared bucket."""
    hashes = bands * rows
    agree = least_agreement(hashes, threshold)

    def banded(batch: pa.RecordBatch) -> dict:
        minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, bands, rows).astype(np.uint64)
        key = np.zeros(minima.shape[:2], np.uint64)
        for r in range(rows):
            key = S.mix(key + minima[:, :, r] * np.uint64(2 * r + 3))
        key = S.mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        return {"c": batch.column(0), "keys": list(key.view(np.int64))}

    keyed = arrow_map(classes.select("c", "sketch"), banded, "c binary, keys array<long>")
    keyed = written(keyed.select("c", F.explode("keys").alias("bucket")), "bands")
    shared = written(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = keyed.join(shared, "bucket").join(classes.select("c", "sketch"), "c").withColumn("heavy", F.lit(0))
    dealt = _in_blocks(members, "bucket", "heavy", BLOCK).repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "c")

    def tie(batches):
        for (_, bi, bj), run in _runs(batches, 3):
            ids, own = run.column("c").to_pylist(), np.array(run.column("own"))
            minima = np.frombuffer(b"".join(run.column("sketch").to_pylist()), "<u4").reshape(-1, hashes)
            root, find = _roots(len(ids))
            a, b, left = [], [], len(ids) - 1
            for i in range(len(ids) - 1):
                if not left:
                    break
                like = (minima[i + 1 :] == minima[i]).sum(1) >= agree
                if bi != bj:
                    like &= own[i + 1 :] != own[i]
                for j in np.flatnonzero(like) + i + 1:
                    x, y = find(i), find(int(j))
                    if x != y:
                        root[y] = x
                        left -= 1
                        a.append(ids[i])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.mapInArrow(tie, "a binary, b binary")


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """From families' members with their sets: per class, block pair and direction ``c, links, other``,
    where ``links`` counts classes at the threshold and ``other`` ties the class into the forest of links."""
    num, den = _fraction(threshold)
    dealt = _in_blocks(sets, "family", "n", BLOCK_SHINGLES).repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "c")

    def count(batches):
        for (_, bi, bj), run in _runs(batches, 3):
            ids, own = run.column("c").to_pylist(), np.array(run.column("own"))
            members = [np.frombuffer(s, "<u8") for s in run.column("grams").to_pylist()]
            sizes = np.array([len(m) for m in members])
            _, local = np.unique(np.concatenate(members), return_inverse=True)
            common = _common(local, sizes)
            root, find = _roots(len(ids))
            links, other = np.zeros(len(ids), np.int64), [None] * len(ids)
            for i in range(len(ids) - 1):
                met = common[i, i + 1 :].astype(np.int64)
                hit = den * met >= num * (sizes[i + 1 :] + sizes[i] - met)
                if bi != bj:
                    hit &= own[i + 1 :] != own[i]
                found = np.flatnonzero(hit) + i + 1
                links[i] += len(found)
                links[found] += 1
                for j in found.tolist():
                    x, y = find(i), find(j)
                    if x != y:  # the later root carries the edge
                        root[max(x, y)] = min(x, y)
                        other[max(x, y)] = ids[min(x, y)]
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_pydict(
                    {"c": pa.array([ids[k] for k in some], pa.binary()), "links": pa.array(links[some]), "other": pa.array([other[k] for k in some], pa.binary())}
                )

    return dealt.mapInArrow(count, "c binary, links long, other binary")


def _fraction(threshold: float) -> tuple[int, int]:
    from fractions import Fraction

    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def _common(local: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of their values sets share, for pairs i < j; ``local`` numbers the sets' values, set by set.

    Bits of COLUMNS values at a time bound the memory, whatever the sets hold; values of one set alone tie nothing.
    """
    count = np.bincount(local)
    number = np.cumsum(count > 1) - 1
    shared = count[local] > 1
    owner, column = np.repeat(np.arange(len(sizes)), sizes)[shared], number[local[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sizes), len(sizes)), np.int32)
    cuts = np.searchsorted(column, np.arange(0, int(number[-1]) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        rows, row = np.unique(owner[a:b], return_inverse=True)
        at = column[a:b] - k * COLUMNS
        bits = np.zeros((len(rows), 8 * (int(at[-1]) // 64 + 1)), np.uint8)
        np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        for i in range(len(rows) - 1):
            common[rows[i], rows[i + 1 :]] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int32)
    return common


def _sets(df: DataFrame) -> DataFrame:
    """``family, size, c, text`` with the text's sorted shingle set in place of the text."""

    def run(batch: pa.RecordBatch) -> dict:
        words, counts = S.word_hashes(batch.column("text").to_pylist())
        values, n = S.shingle_hashes(words, counts)
        ends = np.cumsum(n)
        grams = [np.unique(values[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        return {"family": batch.column("family"), "size": batch.column("size"), "c": batch.column("c"), "grams": [g.astype("<u8").tobytes() for g in grams], "n": [len(g) for g in grams]}

    return arrow_map(df.select("family", "size", "c", "text"), run, "family binary, size long, c binary, grams binary, n long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs``: id, ``text_hash``, ``text_class`` (least id with the same words),
    ``class_id`` (least id of the group that links connect), ``n_links`` (other texts at the
    threshold), ``n_copies`` (other rows with the same words) and ``stays`` (true for the row key
    that represents the group)."""
    bands = bands_for(threshold, recall)
    sig = written(signatures(docs, id_col, text_col, bands * ROWS), "signatures")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = sig.where("c IS NOT NULL").groupBy("c").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    tied = components(written(families(classes, bands, ROWS, threshold), "ties")).withColumnRenamed("node", "c").withColumnRenamed("root", "family")
    tied = written(tied, "families")
    sizes = tied.groupBy("family").agg(F.count("*").alias("size"))
    members = tied.join(written(sizes, "family-sizes"), "family").join(classes.select("c", "rep"), "c")
    members = members.select("family", "size", "c", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    met = texts.join(members.hint("shuffle_hash"), texts["id"].eqNullSafe(members["rep_id"]) & (texts["text_hash"] == members["rep_hash"])).dropDuplicates(["rep_id", "rep_hash", "c"])
    sets = written(_sets(met), "sets")
    heavy = written(sets.groupBy("family").agg(F.sum("n").alias("heavy")), "family-weights")
    links = written(verified(sets.join(heavy, "family"), threshold), "links")
    counted = links.groupBy("c").agg(F.sum("links").alias("links"))
    grouped = components(links.where("other IS NOT NULL"), "c", "other").withColumnRenamed("node", "c")
    classed = classes.select("c", "rep", "copies").join(counted, "c", "left").join(grouped, "c", "left").withColumn("root", F.coalesce("root", "c"))
    classed = written(classed, "classed")
    least = written(classed.groupBy("root").agg(F.min("rep").alias("group_rep")), "groups")
    final = classed.join(least, "root").select("c", "rep", "copies", "links", "group_rep")
    met = sig.drop("sketch").join(written(final, "class-results"), "c", "left")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    return met.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("text_class"),
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("group_rep.id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
        (F.col("c").isNull() | (own == F.col("group_rep"))).alias("stays"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: the least id (of copies with the same id and text, any one).
    Rows without words stay."""
    decided = written(jaccard_classes(docs, id_col, text_col, threshold).select(F.col(id_col).alias("id"), "text_hash", "stays", "n_copies"), "near-classes")
    gone_id, gone_hash, text_hash, nth = (free_name(docs, n) for n in ("__gone_id", "__gone_hash", "__text_hash", "__n"))
    gone = decided.where("NOT stays").select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct().hint("shuffle_hash")
    left = docs.withColumn(text_hash, F.xxhash64(text_col))
    kept = left.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(text_hash) == F.col(gone_hash)), "left_anti")
    # rows with the same id and text carry the same decision: where there are any, one of them stays
    if not decided.where("stays AND n_copies > 0").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        has_words = F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")
        kept = kept.withColumn(nth, F.when(has_words, F.lit(0)).otherwise(F.monotonically_increasing_id())).dropDuplicates([id_col, text_hash, nth]).drop(nth)
    return kept.drop(text_hash)
