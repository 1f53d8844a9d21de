"""Suffix-array dedup: bytes that a repeated string of LENGTH bytes covers are removed, wherever it stands.

Not every suffix can have a partner. Each window of LENGTH bytes chooses the seed (LENGTH / 2 bytes) with the
least hash in it, the leftmost of equals; equal windows choose equal seeds at equal places. A window whose seed
stands nowhere else is unique. A seed with the windows that chose it is a context: the bytes of these windows.
Contexts of one seed are a group. Within a task the windows of many groups are sorted as suffixes, by
deep-shallow sorting (``suffixes``); neighbours that share LENGTH bytes are repeated. Equal contexts
are one with a count before they are shuffled: of more than one, every window is repeated.

A seed in a third of all documents makes no large task. Seeds are counted with partial
aggregation and met by joins that Spark may split. A group with over GROUP different contexts
isn't sorted whole: its contexts are cut into WAYS ranges of their windows; the bytes that all windows of a range share,
longer than before, part them into new groups. Ranges of one window end this, as then all shared bytes are the window.

The driver gets no rows but whether large groups are left. Texts are shuffled twice: to fetch the contexts of seeds
that stand in two places or more, and to be cut.

Defined results for odd rows: a null text is an empty one; texts under LENGTH bytes stay
as they are; rows with the same id and text count as two documents, and so lose all their bytes from LENGTH
on; null ids are ids; other columns pass through, but those called like the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepared, split_batch, text_of, written
from .suffixes import sort_suffixes

#: Bytes of a repeated string.
LENGTH = 400
#: Different contexts that one task sorts together (about half of SORTED), and ranges into which larger groups are cut.
GROUP, WAYS = 2048, 4
#: Bytes of contexts that are sorted at once; window starts that are hashed at once; contexts that a task remembers to have sent.
SORTED, TILE, SENT = 1 << 21, 1 << 18, 1 << 19

_PLACE = 20  # bits of a place within a tile; the rest of a key is the hash
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if n not in _POWERS:
        _POWERS[n] = tuple(np.multiply.accumulate(np.array([1] + [b] * (n - 1), np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS[n]


def _least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys: within blocks from both sides, then across."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def seeds(text: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (document i is ``text[bounds[i]:bounds[i + 1]]``): for each chosen seed its
    document, place, hash, and the first and last window that chose it. Windows stay within documents."""
    size = length // 2
    found: list[tuple] = []
    starts_ok = np.zeros(len(text) + 1, np.int32)
    whole = np.diff(bounds) >= length
    np.add.at(starts_ok, bounds[:-1][whole], 1)
    np.add.at(starts_ok, bounds[1:][whole] - length + 1, -1)
    starts_ok = np.cumsum(starts_ok[:-1]).astype(bool)
    for at in range(0, len(text) - length + 1, TILE):
        part = text[at : at + TILE + length - 1]
        windows = len(part) - length + 1
        ok = np.flatnonzero(starts_ok[at : at + windows])
        if not len(ok):
            continue
        up, down = (p[: len(part)] for p in _powers(TILE + length - 1))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
        hashes = (sums[size:] - sums[:-size]) * up[: len(part) - size + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
        low = np.uint64((1 << _PLACE) - 1)
        least = _least_in((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - size + 1)[ok]
        place = (least & low).astype(np.int64)
        begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (ok[1:] != ok[:-1] + 1)))
        ends = np.append(begins[1:], len(ok)) - 1
        spot = place[begins]
        found.append((spot + at, hashes[spot].view(np.int64), ok[begins] + at, ok[ends] + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, hashes, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
    return np.searchsorted(bounds, lo, "right") - 1, place, hashes, lo, hi


def _laid_out(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, end to end, and where each row begins and the last one ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return text, offsets - offsets[0]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k1, k2, text``: a key of 96 bits for each id and text."""
    text = text_of(text_col).cast("string")
    return docs.select(F.xxhash64(id_col, text).alias("k1"), F.hash(text, F.col(id_col)).alias("k2"), text.alias("text"))


def _shared_seeds(keyed: DataFrame, length: int) -> DataFrame:
    """``k1, k2, seeds``: each document's seeds that stand in two places or more, in any document."""

    def run(batches):
        for whole in batches:
            for part in split_batch(whole):
                text, bounds = _laid_out(part.column(2))
                doc, _, hashes, _, _ = seeds(text, bounds, length)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                begins = np.flatnonzero(np.append(len(doc) > 0, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
                times = np.diff(np.append(begins, len(doc)))
                keys = [part.column(k).take(pa.array(doc[begins])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(hashes[begins]), pa.array(np.minimum(times, 2).astype(np.int32))], ["k1", "k2", "seed", "times"])

    found = keyed.mapInArrow(run, "k1 long, k2 int, seed long, times int")
    shared = found.groupBy("seed").agg(F.sum("times").alias("times")).where("times > 1").select("seed")
    met = found.select("k1", "k2", "seed").join(written(shared, "substring-seeds"), "seed", "left_semi")
    return met.groupBy("k1", "k2").agg(F.collect_set("seed").alias("seeds"))


def _contexts(keyed: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """``k1, k2, place, seed, near, far, context, bytes`` of each shared seed: its place in the document, the least and greatest distance
    from a window's start to it, the context's hash and, once a task, its bytes."""
    met = keyed.join(shared.hint("shuffle_hash"), ["k1", "k2"])
    schema = "k1 long, k2 int, place long, seed long, near int, far int, context binary, bytes binary"

    def run(batches):
        sent: set[bytes] = set()
        for whole in batches:
            for part in split_batch(whole):
                text, bounds = _laid_out(part.column(2))
                doc, place, hashes, lo, hi = seeds(text, bounds, length)
                wanted, own = part.column(3), np.searchsorted(doc, np.arange(part.num_rows + 1))
                keep = np.concatenate([np.flatnonzero(np.isin(hashes[a:b], wanted[i].values.to_numpy())) + a for i, (a, b) in enumerate(zip(own[:-1], own[1:], strict=True))] + [np.zeros(0, np.int64)]).astype(np.int64)
                doc, place, hashes, lo, hi = (x[keep] for x in (doc, place, hashes, lo, hi))
                raw, names, contents = text.tobytes(), [], []
                for a, b, far in zip(lo.tolist(), (hi + length).tolist(), (place - lo).tolist(), strict=True):
                    content = raw[a:b]
                    name = hashlib.blake2b(content, digest_size=16, salt=far.to_bytes(4, "little")).digest()
                    names.append(name)
                    contents.append(None if name in sent else content)
                    sent.add(name)
                if len(sent) > SENT:
                    sent.clear()
                keys = [part.column(k).take(pa.array(doc)) for k in (0, 1)]
                rest = [pa.array(place - bounds[doc]), pa.array(hashes), pa.array((place - hi).astype(np.int32)), pa.array((place - lo).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*keys, *rest, pa.array(names, pa.binary()), pa.array(contents, pa.binary())], ["k1", "k2", "place", "seed", "near", "far", "context", "bytes"])

    return met.select("k1", "k2", "text", "seeds").mapInArrow(run, schema)


def _sorted_groups(groups: DataFrame, length: int) -> DataFrame:
    """``context, begin, end``: the repeated stretches of contexts (``grp, context, near, far, bytes``), as distances from the seed."""

    def marks(rows: list[tuple]) -> Iterator[tuple]:
        text = b"".join(r[4] for r in rows)
        at = np.cumsum([0] + [len(r[4]) for r in rows])[:-1]
        counts = np.array([r[3] - r[2] + 1 for r in rows])
        owner = np.repeat(np.arange(len(rows)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        _, group = np.unique([r[0] for r in rows], return_inverse=True)
        far = np.array([r[3] for r in rows])
        order, lcp = sort_suffixes(text, at[owner] + step, group[owner] * length + far[owner] - step, length)
        again = np.zeros(len(order), bool)
        hit = np.flatnonzero(lcp >= length)
        again[order[hit]] = again[order[hit - 1]] = True
        runs = np.flatnonzero(again)
        if not len(runs):
            return
        begins = np.flatnonzero(np.append(True, (np.diff(runs) > 1) | (np.diff(owner[runs]) != 0)))
        ends = np.append(begins[1:], len(runs)) - 1
        for b, e in zip(runs[begins].tolist(), runs[ends].tolist(), strict=True):
            row = rows[owner[b]]
            yield row[1], int(step[b]) - row[3], int(step[e]) - row[3] + length

    def run(batches):
        held: list[tuple] = []
        size = 0

        def out(rows):
            found = list(zip(*marks(rows), strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())], ["context", "begin", "end"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][0] != row[0]:
                    if len(group) > 1:  # a context alone with its seed has nothing to be compared with
                        held += group
                        size += sum(len(r[4]) for r in group)
                    group = []
                    if size > SORTED:
                        yield out(held)
                        held, size = [], 0
                group.append(row)
        held += group if len(group) > 1 else []
        if held:
            yield out(held)

    dealt = groups.select("grp", "context", "near", "far", "bytes").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "context binary, begin int, end int")


def _cut_into_ranges(groups: DataFrame, length: int) -> DataFrame:
    """Contexts cut into WAYS ranges of their windows: ``whole`` (the context), and the range as a context of the group of what its windows share."""

    def run(batches):
        for whole in batches:
            for batch in split_batch(whole):
                rows = []
                for context, near, far, content, lowest, highest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    width = -(-(highest - lowest + 1) // WAYS)
                    for low in range(lowest, highest + 1, width):
                        high = min(low + width - 1, highest)
                        a, b = max(near, low), min(far, high)
                        if a > b:
                            continue
                        seed = far  # the seed's place in the context's bytes
                        own = content[seed - b : seed - a + length]
                        core = content[seed - low : seed - high + length]  # what every window of the range has
                        grp = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=low.to_bytes(4, "little") + high.to_bytes(4, "little")).digest(), "little", signed=True)
                        rows.append((context, grp, a, b, low, high, hashlib.blake2b(own, digest_size=16, salt=b.to_bytes(4, "little") + low.to_bytes(4, "little") + high.to_bytes(4, "little")).digest(), own))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["whole", "grp", "near", "far", "low", "high", "context", "bytes"])

    schema = "whole binary, grp long, near int, far int, low int, high int, context binary, bytes binary"
    return groups.select("context", "near", "far", "bytes", "low", "high").mapInArrow(run, schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``k1, k2, spans``: of each document (by the key of its id and text) the stretches of bytes that lie in repeated windows, not yet merged."""
    prepared(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    shared = _shared_seeds(keyed, length)
    found = written(_contexts(keyed, shared, length), "substring-contexts", compression="zstd")
    level = found.withColumnRenamed("seed", "grp").withColumns({"low": F.lit(0), "high": F.lit(length - length // 2), "n": F.lit(1)})
    marks, ties = [], []
    while True:
        # a context's columns but its bytes follow from its hash
        once = level.groupBy("context").agg(*[F.max(c).alias(c) for c in ("grp", "near", "far", "low", "high", "bytes")], F.sum("n").alias("n"))
        once = written(once, "substring-once", compression="zstd")
        large = written(once.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("grp"), "substring-large")
        own = once.where("n > 1").select("context", (-F.col("far")).alias("begin"), (length - F.col("near")).alias("end"))
        own = own.unionByName(_sorted_groups(once.join(large, "grp", "left_anti"), length))
        for tie in reversed(ties):  # back from ranges to the contexts that hold them
            own = own.join(tie, "context").select(F.col("whole").alias("context"), "begin", "end")
        marks.append(own)
        if large.isEmpty():
            break
        level = written(_cut_into_ranges(once.join(large, "grp", "left_semi"), length), "substring-ranges", compression="zstd")
        ties.append(level.select("context", "whole"))
        level = level.withColumn("n", F.lit(1))
    marked = marks[0]
    for more in marks[1:]:
        marked = marked.unionByName(more)
    spans = found.select("k1", "k2", "place", "context").join(written(marked, "substring-marks"), "context")
    spans = spans.select("k1", "k2", F.struct((F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end")).alias("span"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching stretches."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``removed`` (array of the maximal removed runs of UTF-8 bytes, end exclusive) and ``kept``
    (the bytes that are left; a cut may part a character) in place of any columns of those names."""
    gone = repeated(docs, id_col, text_col, length)
    k1, k2, spans = (free_name(docs, f"__{c}") for c in ("k1", "k2", "spans"))
    gone = gone.select(F.col("k1").alias(f"{k1}r"), F.col("k2").alias(f"{k2}r"), F.col("spans").alias(spans))
    text = text_of(text_col).cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(id_col, text), k2: F.hash(text, F.col(id_col))})
    met = keyed.join(gone.hint("shuffle_hash"), (F.col(k1) == F.col(f"{k1}r")) & (F.col(k2) == F.col(f"{k2}r")), "left")
    bare = docs.drop("removed", "kept")
    taken = free_name(docs, "__text")
    plain = met.select(*[F.col(f"`{c}`") for c in bare.columns], F.col(spans), text.cast("binary").alias(taken))
    schema = bare.select("*", F.expr("cast(array() AS array<struct<begin: bigint, end: bigint>>)").alias("removed"), F.lit(b"").alias("kept")).schema
    width = len(bare.columns)

    def run(batches):
        for whole in batches:
            for part in split_batch(whole):
                runs, kept = [], []
                for found, raw in zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True):
                    own = merged([(s["begin"], s["end"]) for s in found or ()])
                    at = [0, *[x for r in own for x in r], len(raw)]
                    runs.append([{"begin": b, "end": e} for b, e in own])
                    kept.append(b"".join([raw[b:e] for b, e in zip(at[::2], at[1::2], strict=True)]) if own else raw)
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(runs, kind), pa.array(kept, pa.binary())], names=schema.names)

    return plain.mapInArrow(run, schema)
