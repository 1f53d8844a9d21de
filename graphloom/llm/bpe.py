"""Byte-level BPE: encode texts to ids and back, as the public rank files define it.

Pre-tokenisation runs without regular expressions. Every code point gets one of
twelve classes; a finite automaton over classes knows where a token starts. Its
transition functions compose associatively, so blocks are scanned independently
(each block's composite function first, then the entry states, then all states)
with array gathers. Slices between starts go through pair merging, cached by
slice; ids and the byte offset of each id are kept, and decoding gathers bytes
from the vocabulary by those offsets.

Defined results for odd rows: a null text counts as empty and has no ids; a null
id column stays null; repeated rows each get their own row; other columns are
neither read nor returned; an empty table gives an empty result; a text of any
length is scanned in chunks that carry the automaton's state.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Classes of code points.
END, LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, ONE, R, V, L, E = range(12)
# States: inside a letter, number or other run; after a blank or other white space;
# after a lone quote; after a quote and r, v or l; after a whole contraction.
START, IN_L, IN_N, IN_O, AT_BLANK, AT_SPACE, AT_QUOTE, AT_R, AT_V, AT_LL, DONE = range(11)
N_STATES = 11
CHUNK = 1 << 20

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        first = category(chr(c))[0]
        if first == "L":
            table[c] = LETTER
        elif first == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    for char, kind in ((" ", BLANK), ("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E), *((x, ONE) for x in "stmd")):
        table[ord(char)] = kind
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, 'a token starts here' and 'a token starts one earlier', by class and state."""
    step = np.zeros((12, N_STATES), np.intp)
    here = np.zeros((12, N_STATES), bool)
    back = np.zeros((12, N_STATES), bool)
    letters = {LETTER, ONE, R, V, L, E}
    fresh = {c: IN_L for c in letters} | {NUMBER: IN_N, OTHER: IN_O, QUOTE: AT_QUOTE, BLANK: AT_BLANK, SPACE: AT_SPACE}
    runs = {IN_L: letters, IN_N: {NUMBER}, IN_O: {OTHER, QUOTE}}

    def move(state: int, c: int) -> tuple[int, bool]:
        if state in runs and c in runs[state]:
            return state, False
        return fresh[c], True

    for c in range(12):
        for s in range(N_STATES):
            pending = s in (AT_R, AT_V, AT_LL)
            if c == END:
                step[c, s], here[c, s], back[c, s] = START, True, pending
            elif s == AT_QUOTE and c in (ONE, R, V, L):
                step[c, s] = {ONE: DONE, R: AT_R, V: AT_V, L: AT_LL}[c]
            elif s == AT_QUOTE and c in (OTHER, QUOTE):
                step[c, s] = IN_O
            elif pending and c == {AT_R: E, AT_V: E, AT_LL: L}[s]:
                step[c, s] = DONE
            elif pending:  # no contraction: its letter starts a token
                step[c, s], here[c, s] = move(IN_L, c)
                back[c, s] = True
            elif s in (AT_BLANK, AT_SPACE) and c in (BLANK, SPACE):
                step[c, s] = fresh[c]
            elif s == AT_BLANK:  # the blank belongs to what follows
                step[c, s] = IN_O if c == QUOTE else fresh[c]
                back[c, s] = True
            elif s == AT_SPACE:
                step[c, s], here[c, s], back[c, s] = fresh[c], True, True
            else:
                step[c, s], here[c, s] = move(s, c)
    return step.ravel(), here.ravel(), back.ravel()


_TABLES: tuple | None = None


def _tables() -> tuple:
    global _TABLES
    if _TABLES is None:
        _TABLES = (_classes(), *_automaton())
    return _TABLES


def scan(kinds: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each class of ``kinds``, and the one after the last."""
    step = _tables()[1]
    n = len(kinds)
    width = max(16, int(n**0.5))
    blocks = -(-n // width)
    padded = np.full(blocks * width, END, np.intp)
    padded[:n] = kinds
    columns = np.ascontiguousarray((padded * N_STATES).reshape(blocks, width).T)
    whole = np.tile(np.arange(N_STATES), (blocks, 1))
    for column in columns:  # each block's function, composed left to right
        whole = step.take(column[:, None] + whole)
    entry = np.empty(blocks, np.intp)
    for k in range(blocks):
        entry[k] = state
        state = whole[k, state]
    before = np.empty((width, blocks), np.int8)
    for j, column in enumerate(columns):
        before[j] = entry
        entry = step.take(column + entry)
    before = before.T.ravel()
    last = step[kinds[-1] * N_STATES + before[n - 1]] if n else state
    return before[:n], int(last)


def token_starts(text: str, ends: np.ndarray) -> np.ndarray:
    """Where tokens start in ``text``; ``ends`` are places of separators between documents."""
    classes, _, here, back = _tables()
    starts, state, n = np.zeros(len(text) + 1, bool), START, len(text)
    for at in range(0, n, CHUNK):
        part = text[at : at + CHUNK]
        kinds = classes[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.intp)
        inside = ends[(ends >= at) & (ends < at + len(part))] - at
        kinds[inside] = END
        before, state = scan(kinds, state)
        pair = kinds * N_STATES + before
        starts[at : at + len(part)] |= here[pair]
        earlier = np.flatnonzero(back[pair]) + at - 1
        starts[earlier] = True
    if state in (AT_R, AT_V, AT_LL):
        starts[n - 1] = True
    return np.flatnonzero(starts[:n])


class Vocabulary:
    """Ranks of byte strings, merging with a bounded cache, and the bytes of all ids in one array."""

    #: Slices the cache may hold; pieces over LONG bytes are merged with a heap.
    MOST_CACHED, LONG = 1 << 16, 96
    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            by_id[rank] = piece
        self.lengths = np.array([len(p) for p in by_id], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        keys, made = array("q"), array("q")  # every way to make a token from two
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                if (x := ranks.get(piece[:k])) is not None and (y := ranks.get(piece[k:])) is not None:
                    keys.append(x << 32 | y)
                    made.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.frombuffer(keys, np.int64)[order], np.frombuffer(made, np.int64)[order]
        self.cache: dict[str, bytes] = {}

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.NONE)

    def learn(self, slices: list[str]) -> None:
        """Merge the slices the cache lacks, all at once, into the cache."""
        if len(self.cache) > self.MOST_CACHED:
            self.cache.clear()
        missing = set(slices).difference(self.cache)
        words, pieces = [], []
        for s in missing:
            piece = s.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(piece)) is not None:
                self.cache[s] = pack("<I", whole)
            elif len(piece) > self.LONG:
                merged = self._merge_long(piece)
                self.cache[s] = pack(f"<{len(merged)}I", *merged)
            else:
                words.append(s)
                pieces.append(piece)
        if words:
            self.cache.update(zip(words, self._merge_all(pieces), strict=True))

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """One merge a step in every piece: its lowest rank, the leftmost of equals."""
        counts = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), counts)
        ranks = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self._rank(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(ids)]]))
            best = np.minimum.reduceat(ranks, first)
            if (best == self.NONE).any():
                over = np.repeat(best == self.NONE, sizes)
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, ranks = ids[~over], word[~over], ranks[~over]
                best, sizes = best[best < self.NONE], sizes[best < self.NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            at -= np.arange(len(at))
            ranks[at] = self.NONE
            for left in (at[at + 1 < len(ids)], at[at > 0] - 1):
                left = left[word[left] == word[left + 1]]
                ranks[left] = self._rank(ids[left], ids[left + 1])
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        data = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(words, minlength=len(pieces)))).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap over a linked list: n log n steps."""
        n, get = len(piece), self.ranks.get
        stop, prev, following = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = following[i]
            if j < n and (rank := get(piece[i : stop[j]])) is not None:
                heapq.heappush(heap, (rank, i, stop[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = following[i]
            if not alive[i] or j >= n or stop[j] != end:
                continue
            alive[j], stop[i], following[i] = False, end, following[j]
            if following[j] < n:
                prev[following[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [self.ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = token_starts(joined, ends)
        bounds = starts.tolist()
        slices = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        cuts = np.searchsorted(starts, ends)  # the separators are tokens of their own
        self.learn(slices)
        known, out, first = self.cache.__getitem__, [], 0
        for cut in cuts.tolist():
            out.append(b"".join(map(known, slices[first:cut])))
            first = cut + 1
        return out

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte offset of each id in the text, and the text's length last."""
        ids = np.frombuffer(packed, "<u4")
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, packed: bytes, offsets: np.ndarray) -> bytes:
        """The bytes of the ids, gathered by offset in pieces of bounded size."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for a in range(0, len(ids), CHUNK):
            part, at = ids[a : a + CHUNK], offsets[a : a + CHUNK + 1]
            lengths = self.lengths[part]
            if not np.array_equal(lengths, np.diff(at)):
                raise ValueError("offsets don't belong to these ids")
            shift = np.repeat(self.places[part] - (at[:-1] - at[0]), lengths)
            out.append(self.bytes[shift + np.arange(at[-1] - at[0])].tobytes())
        return b"".join(out)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """A worker's vocabulary of a rank file, made once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(read_ranks(data))
    return _LOADED[key]


def _shared(df: DataFrame, rank_file: str):
    """The rank file for all tasks: read once by the driver (a fixed vocabulary, under 16 MB)."""
    with open(rank_file, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("a rank file of over 16 MB isn't broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids`` and ``offsets`` (both packed little-endian unsigned 32-bit;
    the offsets end with the text's length in bytes)."""
    ranks = _shared(df, rank_file)

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(ranks.value)
        packed = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
        return {
            "id": batch.column(0),
            "n_tokens": [len(p) // 4 for p in packed],
            "ids": packed,
            "offsets": [vocab.offsets(p).astype("<u4").tobytes() for p in packed],
        }

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, n_tokens long, ids binary, offsets binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """What ``encode`` returned, with ``decoded`` (the text's bytes) in place of ``offsets``."""
    ranks = _shared(df, rank_file)

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(ranks.value)
        places = [np.frombuffer(o, "<u4").astype(np.int64) for o in batch.column(3).to_pylist()]
        return {
            "id": batch.column(0),
            "n_tokens": batch.column(1),
            "ids": batch.column(2),
            "decoded": [vocab.decode(i, o) for i, o in zip(batch.column(2).to_pylist(), places, strict=True)],
        }

    source = df.select(F.col(id_col).alias("id"), "n_tokens", "ids", "offsets")
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one pass, so that a task needs one worker: id, ``n_tokens``, ``ids`` and ``decoded``."""
    ranks = _shared(df, rank_file)

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(ranks.value)
        packed = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
        return {"id": batch.column(0), "n_tokens": [len(p) // 4 for p in packed], "ids": packed, "decoded": [vocab.decode(p, vocab.offsets(p)) for p in packed]}

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def as_array(packed: bytes) -> list[int]:
    """Packed ids as a list (for readers outside Spark)."""
    ids = np.frombuffer(packed, "<u4")
    return (ids if sys.byteorder == "little" else ids.byteswap()).tolist()
