"""Benchmark decontamination: filters that lose nothing, Smith-Waterman scores.

Words are folded (lower case, ASCII punctuation parts them). The score is the best
local alignment of a document with an item over the score of the item aligned with
itself, which edits and paraphrases lower gradually. The rows are those of aligning
every document with every item; two bounds spare most of that work:

* An alignment at the threshold matches ``need`` of an item's L words in order, so at
  least VOTES of any L - need + VOTES of them, within a span of bounded length. Those
  taken are an item's rarest, by a first scan that counts the benchmark's words in the
  documents. A word that occurs nowhere is taken too, but can't make up for another.
* Around such places words of the item count MATCH and all others GAP. No alignment
  scores more than the sum of its words, and the best lies within a stretch of
  positive running sums. Stretches whose sum reaches the threshold are aligned.

Texts are never shuffled. The benchmark travels to the tasks in blocks of at most
BLOCK_BYTES of text, one pair of scans a block, so a benchmark of any size works.

Defined results for odd rows: null and empty texts match nothing; items of fewer
than ``n`` words, or null, match nothing; null ids are returned as they are;
an alignment scores as much as ``n`` equal words at least; repeated rows each get
their own result; several good alignments of one document and item give one row,
the best and earliest; other columns pass through
``decontaminate`` unchanged, whatever their names; empty tables give no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import arrow_map, ship, split_batch

#: Words of the shortest item, rare words that must meet, and the least score of a match.
N, VOTES, THRESHOLD = 3, 3, 0.5
MATCH, OTHER, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
#: Cells of an alignment matrix row that are computed at once.
CELLS = 1 << 20
#: Places of rare words, or words around them, that are looked at together.
PLACES = 1 << 21


class Block:
    """Benchmark items in a task: their words' hashes, and which words each item has."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        words, counts = S.word_hashes([t or "" for _, t in items], fold=True)
        self.length = counts.astype(np.int64)
        ends = np.cumsum(counts)
        self.words = [words[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        self.distinct, self.word = np.unique(words, return_inverse=True)
        self.pairs = np.unique(self.key(np.repeat(np.arange(len(items)), counts), self.word))

    def key(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (item * max(1, len(self.distinct)) + word).astype(np.uint64)


class Filter:
    """What an alignment at ``threshold`` needs of each item, and the items of each rare word."""

    def __init__(self, block: Block, frequency: np.ndarray, threshold: float):
        length = block.length
        self.least = np.maximum(threshold, N / np.maximum(length, 1)) * MATCH * length
        need = np.ceil(self.least / MATCH - 1e-9).astype(np.int64)
        self.votes = np.minimum(need, VOTES)
        #: every word of a span that isn't matched costs one at least
        self.reach = np.floor((MATCH - GAP) * length - self.least + 1e-9).astype(np.int64)
        items, words = [], []
        first = np.cumsum(length) - length
        for k in np.flatnonzero((length >= N) & (need <= length)).tolist():
            own = block.word[first[k] : first[k] + length[k]]
            rare = np.unique(own[np.argsort(frequency[own], kind="stable")[: length[k] - need[k] + self.votes[k]]])
            items.append(np.full(len(rare), k))
            words.append(rare)
        of, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, words))
        self.items = of[np.argsort(word, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(block.distinct)))]).astype(np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``n[k]`` of them, for all k."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _parts(sizes: np.ndarray):
    """Slices of consecutive entries of at most PLACES together, or of a single one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
        yield at, stop
        at = stop


def stretches(counts: np.ndarray, where: np.ndarray, which: np.ndarray, block: Block, rare: Filter) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, word after the last) of all stretches that can hold an alignment.

    ``where`` are the words that some item has (``which``), of rows of ``counts`` words.
    """
    total = int(counts.sum())
    row_of, row_end = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    row_first = row_end - counts
    word_at = np.full(total, -1)
    word_at[where] = which
    met = S.Lookup(block.pairs)
    n = rare.first[which + 1] - rare.first[which]
    by_row = np.bincount(row_of[where], weights=n, minlength=len(counts)).astype(np.int64)
    edges = np.searchsorted(where, np.concatenate([row_first, [total]]))
    out = []
    for r0, r1 in _parts(by_row):
        own = slice(edges[r0], edges[r1])
        keys = rare.items[_ranges(rare.first[which[own]], n[own])] * total + np.repeat(where[own], n[own])
        keys.sort()
        item, at = np.divmod(keys, total)
        other = np.minimum(np.arange(len(keys)) + rare.votes[item] - 1, max(0, len(keys) - 1))
        full = (np.arange(len(keys)) + rare.votes[item] <= len(keys)) & (item[other] == item) & (row_of[at[other]] == row_of[at]) & (at[other] - at < rare.reach[item])
        item, low, high = item[full], at[full], at[other[full]]
        row = row_of[low]
        start, stop = np.maximum(row_first[row], high - rare.reach[item] + 1), np.minimum(row_end[row], low + rare.reach[item])
        if not len(item):
            continue
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
        heads = np.flatnonzero(fresh)
        item, start, stop = item[heads], start[heads], stop[np.concatenate([heads[1:], [len(fresh)]]) - 1]
        for a, b in _parts(stop - start):
            size = stop[a:b] - start[a:b]
            place, owner = _ranges(start[a:b], size), np.repeat(np.arange(b - a), size)
            inner = np.flatnonzero(word_at[place] >= 0)
            hit = inner[met.find(block.key(item[a:b][owner[inner]], word_at[place[inner]]))[0]]
            gain = np.full(len(place), GAP, np.int64)
            gain[hit] = MATCH
            # sums above the least so far, window by window: each window starts below all before
            sums = np.cumsum(gain) - owner * (MATCH - GAP) * (int(size.max()) + 1)
            before = sums - gain
            above = sums - np.minimum.accumulate(np.minimum(sums, before))
            up = above > 0
            begins = np.flatnonzero(up & np.concatenate([[True], ~up[:-1] | (owner[1:] != owner[:-1])]))
            if not len(begins):
                continue
            top = np.maximum.reduceat(np.where(up, above, 0), begins)
            last = np.maximum.reduceat(np.where(up, np.arange(len(up)), 0), begins)
            good = top >= rare.least[item[a:b][owner[begins]]] - 1e-9
            for s, e in zip(begins[good].tolist(), last[good].tolist(), strict=True):
                r = int(row_of[place[s]])
                out.append((r, int(item[a + owner[s]]), int(place[s] - row_first[r]), int(place[e] - row_first[r]) + 1))
    return sorted(out)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each item and window, and where it ends in both (exclusive)."""
    best, end_w, end_i = (np.zeros(len(items), np.int64) for _ in range(3))
    order = np.argsort([len(w) for w in windows], kind="stable")
    at = 0
    while at < len(order):
        width = len(windows[order[at]])
        stop = at + 1
        while stop < len(order) and (width := max(width, len(windows[order[stop]]))) * (stop + 1 - at) <= CELLS:
            stop += 1
        rows = order[at:stop]
        width, height = max(len(windows[r]) for r in rows), max(len(items[r]) for r in rows)
        text, item = np.zeros((len(rows), width), np.uint64), np.ones((len(rows), height), np.uint64)
        for k, r in enumerate(rows):
            text[k, : len(windows[r])] = windows[r]
            item[k, : len(items[r])] = items[r]
        inside = np.arange(width)[None, :] < np.array([len(windows[r]) for r in rows])[:, None]
        tall = np.array([len(items[r]) for r in rows])
        score = np.zeros((len(rows), width + 1), np.int32)
        slope = (np.arange(width + 1) * -GAP).astype(np.int32)
        for i in range(height):
            same = (text == item[:, i : i + 1]) & inside & (i < tall)[:, None]
            fresh = np.maximum(score + GAP, 0)
            fresh[:, 1:] = np.maximum(fresh[:, 1:], score[:, :-1] + np.where(same, MATCH, OTHER))
            score = np.maximum.accumulate(fresh + slope, axis=1) - slope
            top = score.argmax(1)
            high = score[np.arange(len(rows)), top]
            better = high > best[rows]
            best[rows[better]], end_w[rows[better]], end_i[rows[better]] = high[better], top[better], i + 1
        at = stop
    return best, end_w, end_i


def matches(texts: list[str], block: Block, rare: Filter) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, word after the last), best of each row and item."""
    words, counts = S.word_hashes(texts, fold=True)
    where, which = S.Lookup(block.distinct).find(words)
    if not len(where):
        return []
    word_first = np.cumsum(counts) - counts
    tasks = stretches(counts, where, which, block, rare)
    items = [block.words[item] for _, item, _, _ in tasks]
    windows = [words[word_first[r] + a : word_first[r] + b] for r, _, a, b in tasks]
    best, end_w, end_i = align(items, windows)
    good = [k for k in range(len(tasks)) if best[k] >= rare.least[tasks[k][1]] - 1e-9]
    back, start_w, _ = align([items[k][: end_i[k]][::-1] for k in good], [windows[k][: end_w[k]][::-1] for k in good])
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, from_end in zip(good, start_w.tolist(), strict=True):
        r, item, a, _ = tasks[k]
        found = (float(best[k]) / (MATCH * len(items[k])), a + int(end_w[k]) - from_end, a + int(end_w[k]))
        if (r, item) not in out or found[0] > out[r, item][0]:
            out[r, item] = found
    return [(r, item, *found) for (r, item), found in sorted(out.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's items in blocks of bounded size."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // (BLOCK_BYTES // 2)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Block(sorted(((r["item"], r["text"]) for r in part.toLocalIterator()), key=lambda x: (str(x[0]), x[1])))


def _finder(docs: DataFrame, text_col: str, block: Block, threshold: float):
    """A function from texts to matches with the block's items, after the scan that counts words."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(block)  # at most about BLOCK_BYTES of text

    def count(batch: pa.RecordBatch) -> dict | None:
        words, _ = S.word_hashes([t or "" for t in batch.column(0).to_pylist()], fold=True)
        _, which = S.Lookup(known.value.distinct).find(words)
        if not len(which):
            return None
        word, n = np.unique(which, return_counts=True)
        return {"word": word, "n": n}

    counted = arrow_map(docs.select(F.col(text_col).alias("text")), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(block.distinct), np.int64)
    for r in counted.toLocalIterator():  # at most the block's words
        frequency[r["word"]] = r["n"]
    shared = spark.sparkContext.broadcast(Filter(block, frequency, threshold))

    def find(texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        return matches(texts, known.value, shared.value)

    return find


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item that align at ``threshold`` or more:
    id, item, ``score`` (1 for a whole copy) and the document's words from ``first_word`` up to ``end_word``."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, score double, first_word long, end_word long"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        find, ids = _finder(docs, text_col, block, threshold), block.ids

        def run(batch: pa.RecordBatch, find=find, ids=ids) -> dict | None:
            found = find([t or "" for t in batch.column(1).to_pylist()])
            if not found:
                return None
            own = batch.column(0).take(pa.array([f[0] for f in found]))
            return {"id": own, "item": [ids[f[1]] for f in found], "score": [f[2] for f in found], "first_word": [f[3] for f in found], "end_word": [f[4] for f in found]}

        part = arrow_map(source, run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col if item_col != id_col else "item"})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that align with an item; rows are dropped where they are read."""
    out, at = docs, docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text):
        find = _finder(docs, text_col, block, threshold)

        def run(batches, find=find):
            for whole in batches:
                for batch in split_batch(whole):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[f[0] for f in find([t or "" for t in batch.column(at).to_pylist()])]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
