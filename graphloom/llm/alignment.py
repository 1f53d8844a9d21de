"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte, and what they overlap.

Tokenizer A is a byte-level BPE (merges in a JSON file), B a piece BPE with byte fallback (a
model file). Both cut the bytes of space + text. A whole batch of documents is laid end to
end with each document's byte offset: one ``bincount`` of A's ends and one of B's mark the bytes
where a token ends, groups are cut where both occur, and a link (an A token and a B token
that share bytes) is a stretch between two neighbouring ends of either kind. Prefix sums
over the bytes, read at the documents' offsets, give each document's figures.

Counts of id pairs over the corpus need every link twice: once to count, once to add up. The
ids are written to a table with batches of about BATCH bytes of text a row, gathered in chunks
of about CHUNK bytes; a chunk asks once for each of its different pairs. So the pairs are shuffled as
rows by (chunk, pair), not by link: a frequent pair has one row a chunk, and no
key grows faster than the chunks. The best count by B id is broadcast: no more rows than B has pieces.

Defined results for odd rows: null and empty texts, and texts whose tokens' joined bytes
differ from space + text (a text with U+2581, for one), have no tokens and zeros; null and repeated ids are rows like others;
a text longer than a chunk is a chunk of its own; an empty table gives an empty result. Other
columns don't pass through: the id names the row.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from .common import prepared, split_batch, text_of, written

#: Bytes of text in a row of the table of ids, and in a chunk, that is, what a task holds at once.
BATCH, CHUNK = 1 << 19, 32 << 20
#: How hard packed ids are compressed: level 1 leaves 0.69 of their bytes, level 3 0.58.
LEVEL = 3
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: a printable Latin-1 character is itself, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies and their tokens' bytes."""

    def __init__(self, bpe_json: bytes, piece_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        said = json.loads(bpe_json)["model"]
        alphabet = byte_alphabet()
        special = {t["content"] for t in json.loads(bpe_json)["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in said["vocab"].items() if token not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in said["merges"]]
        order = [said["vocab"][token] for token in merged]
        if order != sorted(order):
            raise ValueError("merges whose results aren't numbered in their order aren't ranks")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(t) for t in side], np.int64) for side in self.bytes)
        self.kinds = tuple("H" if len(side) <= 1 << 16 else "I" for side in self.bytes)
        self.decimals = _decimals(max(len(a_bytes), len(b_bytes)))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Of each text both packed id sequences, or None without tokens."""
        out: list[tuple[bytes, bytes] | None] = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            spaced = " " + (text or "")
            ids, raw = (self.a.encode_ordinary(spaced), b), spaced.encode()
            whole = text and all(b"".join(map(side.__getitem__, own)) == raw for side, own in zip(self.bytes, ids, strict=True))
            out.append(tuple(array(kind, own).tobytes() for kind, own in zip(self.kinds, ids, strict=True)) if whole else None)
        return out


def _decimals(most: int) -> np.ndarray:
    """Of each (separator, id) the decimal digits, the separator and spaces up to 8 bytes, as one number."""
    if most > 10**7:
        raise ValueError("ids of more than seven digits")
    return np.frombuffer(b"".join(f"{i}{separator}".ljust(8).encode() for separator in ",|;" for i in range(most)), np.uint64)


class Batch:
    """Documents laid end to end: ids of both sides, and the marks over their bytes."""

    def __init__(self, lengths, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.a_ends, self.b_ends = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
        size = int(self.a_ends[-1]) if len(a) else 0
        at_a, at_b = np.bincount(self.a_ends, minlength=size + 1), np.bincount(self.b_ends, minlength=size + 1)
        self.upto_a, self.upto_b = np.cumsum(at_a), np.cumsum(at_b)
        self.cut, self.either = (at_a & at_b).astype(bool), (at_a | at_b).astype(bool)
        #: byte at which each document ends
        self.doc_ends = np.concatenate([[0], self.a_ends])[np.cumsum(n_a)]

    def per_document(self, marks: np.ndarray) -> np.ndarray:
        """Marks in each document's bytes."""
        return np.diff(np.cumsum(marks)[self.doc_ends], prepend=0)

    def links(self, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """The pair a * pieces + b of each link, and the link at which each document ends."""
        ends = np.flatnonzero(self.either)
        pairs = self.a[self.upto_a[ends - 1]].astype(np.int64) * pieces + self.b[self.upto_b[ends - 1]]
        return pairs, np.cumsum(self.either)[self.doc_ends]

    def groups(self, decimals: np.ndarray) -> list[bytes]:
        """Each document's groups, ``a1,a2|b1;a3|b2,b3``: a token's place is what lies before it on both sides."""
        most = len(decimals) // 3
        cuts, before = np.flatnonzero(self.cut), np.cumsum(self.cut)
        b_before = np.concatenate([[0], self.upto_b[cuts]])
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + b_before[before[self.a_ends - 1]]] = self.a + most * self.cut[self.a_ends]
        codes[np.arange(len(self.b)) + self.upto_a[cuts][before[self.b_ends - 1]]] = self.b + 2 * most * self.cut[self.b_ends]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [decimals[codes[s:e]].tobytes().translate(None, b" ")[:-1] for s, e in zip([0, *ends], ends, strict=False)]


_LOADED: dict[str, Tokenizers] = {}


def _files(spark: SparkSession, bpe_json: str, piece_model: str, pattern: str):
    """Both files for all tasks: read once by the driver (fixed vocabularies, under 16 MB)."""
    found = []
    for path in (bpe_json, piece_model):
        with open(path, "rb") as f:
            found.append(f.read())
    if sum(map(len, found)) > 16 << 20:
        raise ValueError("vocabularies of over 16 MB aren't broadcast")
    return spark.sparkContext.broadcast((*found, pattern))


def tokenizers(files) -> Tokenizers:
    """A worker's tokenizers of these files, made once."""
    key = hashlib.sha256(repr([hashlib.sha256(f if isinstance(f, bytes) else f.encode()).hexdigest() for f in files]).encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(*files)
    return _LOADED[key]


def _encoded(both: Tokenizers, texts: list[str | None]) -> Batch:
    found = [p or (b"", b"") for p in both.encode(texts)]
    sides = [np.frombuffer(b"".join([p[k] for p in found]), both.kinds[k]) for k in (0, 1)]
    counts = [np.array([len(p[k]) for p in found], np.int64) // np.dtype(both.kinds[k]).itemsize for k in (0, 1)]
    return Batch(both.lengths, *sides, *counts)


def align(docs: DataFrame, bpe_json: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document the id, ``n_a, n_b, n_groups, n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3`` in decimal ids)."""
    prepared(docs.sparkSession)
    files = _files(docs.sparkSession, bpe_json, piece_model, pattern)
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches):
        both = tokenizers(files.value)
        for whole in batches:
            for part in split_batch(whole, BATCH):
                b = _encoded(both, part.column(1).to_pylist())
                counts = [pa.array(x.astype(np.int64)) for x in (b.n_a, b.n_b, b.per_document(b.cut), b.per_document(b.either))]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([g.decode() for g in b.groups(both.decimals)], pa.string())], names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string").withColumnRenamed("id", id_col)


_ROW = "chunk long, size long, ids array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digests array<string>, a binary, b binary"


def _table(docs: DataFrame, files, id_col: str, text_col: str) -> DataFrame:
    """A row a batch: chunk, ids, counts and digests of its documents, packed and compressed token ids."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = _ROW.format(kind=source.schema["id"].dataType.simpleString())
    names = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from pyspark import TaskContext

        both, codec = tokenizers(files.value), pa.Codec("zstd", compression_level=LEVEL)
        chunk, size = TaskContext.get().partitionId() << 24, 0
        for whole in batches:
            for part in split_batch(whole, BATCH):
                if size and size + part.nbytes > CHUNK:
                    chunk, size = chunk + 1, 0
                size += part.nbytes
                b = _encoded(both, part.column(1).to_pylist())
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in b.groups(both.decimals)]
                counts = [x.tolist() for x in (b.n_a, b.n_b, b.per_document(b.cut), b.per_document(b.either))]
                packed = [codec.compress(x.tobytes(), asbytes=True) for x in (b.a, b.b)]
                row = [[chunk], [part.nbytes], [part.column(0).to_pylist()], *[[c] for c in counts], [digests], *[[p] for p in packed]]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, names, strict=True)], schema=names)

    return source.mapInArrow(run, schema)


def _unpacked(row: dict, both: Tokenizers) -> Batch:
    n_a, n_b = (np.array(row[k], np.int64) for k in ("n_a", "n_b"))
    sides = []
    for k, kind, n in (("a", both.kinds[0], n_a.sum()), ("b", both.kinds[1], n_b.sum())):
        size = int(n) * np.dtype(kind).itemsize
        sides.append(np.frombuffer(pa.decompress(row[k], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind))
    return Batch(both.lengths, *sides, n_a, n_b)


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs and their counts' sums."""
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def link_statistics(docs: DataFrame, bpe_json: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document the id, ``n_a, n_b, n_groups, n_links, groups_sha256``, and over the whole corpus ``n_best`` (links whose
    pair is its B id's most frequent, ties included) and ``count_sum`` (the pairs' counts, over links)."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    files = _files(spark, bpe_json, piece_model, pattern)
    both = tokenizers(files.value)
    pieces = len(both.bytes[1])
    if pieces > 1 << 20:
        raise ValueError("the best counts of over a million pieces aren't broadcast")
    table = written(_table(docs, files, id_col, text_col), "alignment-ids", **_SMALL)

    def count(batches):
        both, held, names = tokenizers(files.value), [], ["pair", "chunk", "n"]
        now = None

        def out():
            pairs, n = _summed([p for p, _ in held], [c for _, c in held])
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(np.full(len(pairs), now, np.int64)), pa.array(n, pa.int64())], names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["chunk"] != now:
                    yield out()
                    held = []
                now = row["chunk"]
                held.append(np.unique(_unpacked(row, both).links(pieces)[0], return_counts=True))
        if held:
            yield out()

    packed = table.select("chunk", "n_a", "n_b", "a", "b")
    asked = packed.mapInArrow(count, "pair long, chunk long, n long")
    totals = asked.select("pair", "chunk", F.sum("n").over(Window.partitionBy("pair")).alias("total"))
    totals = written(totals, "alignment-totals", **_SMALL)
    best = totals.groupBy((F.col("pair") % pieces).alias("piece")).agg(F.max("total").alias("most"))
    marked = totals.join(F.broadcast(best), F.col("pair") % pieces == F.col("piece")).select("chunk", "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = to_arrow_schema(_parse_datatype_string(schema))

    def add_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        both = tokenizers(files.value)
        keys, total, best = (pairs.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(keys)
        keys, total, best = keys[order], total[order], best[order]
        out = []
        for row in (r for batch in rows.to_batches(max_chunksize=1) for r in batch.to_pylist()):
            links, ends = _unpacked(row, both).links(pieces)
            at = np.searchsorted(keys, links)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends], prepend=0) for v in (best.astype(np.int64), total)]
            columns = [row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["digests"]]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, names, strict=True)], schema=names))
        return pa.Table.from_batches(out, names)

    met = table.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(add_up, schema)
    return met.withColumnRenamed("id", id_col)


#: Rows of the table of ids are large: Parquet looks at its buffers after each.
_SMALL = {"compression": "zstd", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
