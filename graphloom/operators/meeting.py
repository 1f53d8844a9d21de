"""Vectors and lists that meet along edges: a node's row is sent once to each block of targets, with the targets it has there,
and not once an edge. Blocks are as many as keep what a task holds small; what is shuffled grows with nodes times blocks at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block's own rows that a task holds, and elements that it puts together at once.
STATE, CHUNK = 64 << 20, 1 << 21
_MERGE = {"min": np.minimum, "max": np.maximum, "sum": np.add}
_BYTES = {"tinyint": 1, "int": 4, "bigint": 8, "double": 8}


def _blocks(spark: SparkSession, size: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-size // STATE))


def _block(node: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int").alias("block")


def _width(vectors: DataFrame, names: list[str]) -> int:
    """Bytes of the columns over all rows."""
    kinds = {c: _BYTES[k.removeprefix("array<").removesuffix(">")] for c, k in vectors.dtypes if c in names}
    return int(vectors.agg(F.sum(sum((F.size(c) * b for c, b in kinds.items()), F.lit(8)))).first()[0] or 0)


def _sent(rows: DataFrame, edges: DataFrame, blocks: int) -> DataFrame:
    """``block, node, targets`` and the other columns of ``rows``: a row for each block that holds targets of the node's ``edges``."""
    lists = edges.select(F.col("src").alias("node"), "dst").repartition("node").groupBy("node", _block("dst", blocks)).agg(F.collect_list("dst").alias("targets"))
    return rows.join(lists, "node")


def _split(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Elements and lengths of a column of arrays."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _split(batch.column(name))[0].reshape(batch.num_rows, -1)


def _arrays(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def gathered(vectors: DataFrame, edges: DataFrame, how: dict[str, str]) -> DataFrame:
    """``node`` and the columns of ``how``: arrays of one length a column, merged element by element (``min``, ``max``, ``sum``)
    over the sources ``src`` of the edges that end at ``dst``. ``vectors(node, ...)`` is read twice."""
    names = list(how)
    rows = vectors.select("node", *names)
    blocks = _blocks(rows.sparkSession, _width(rows, names))
    met = _sent(rows, edges, blocks).select("block", "targets", *names).repartitionById(blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slots, held, used = np.zeros(0, np.int64), np.zeros(0, np.int64), {}, 0
        for batch in batches:
            flat, lengths = _split(batch.column("targets"))
            of = np.repeat(np.arange(batch.num_rows), lengths)
            order = np.argsort(flat, kind="stable")
            values = {c: _matrix(batch, c) for c in names}
            step = max(1, CHUNK // max(1, sum(v.shape[1] for v in values.values())))
            for a in range(0, len(order), step):
                part = order[a : a + step]
                found, starts = np.unique(flat[part], return_index=True)
                fresh = np.setdiff1d(found, ids, assume_unique=True)
                if len(fresh):  # a target takes the next free row when it is first seen
                    at = np.searchsorted(ids, fresh)
                    ids, slots = np.insert(ids, at, fresh), np.insert(slots, at, used + np.arange(len(fresh)))
                    used += len(fresh)
                where = slots[np.searchsorted(ids, found)]
                new = np.isin(found, fresh, assume_unique=True)
                for c, v in values.items():
                    merge = _MERGE[how[c]]
                    if c not in held or len(held[c]) < used:
                        wider = np.zeros((max(1024, 2 * used), v.shape[1]), v.dtype)
                        if c in held:
                            wider[: len(held[c])] = held[c]
                        held[c] = wider
                    got = merge.reduceat(v[of[part]], starts, axis=0)
                    old = ~new
                    held[c][where[new]] = got[new]
                    held[c][where[old]] = merge(held[c][where[old]], got[old])
        for a in range(0, len(ids), 4096):
            rows = slots[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4096]), *[_arrays(held[c][rows]) for c in names]], ["node", *names])

    return met.drop("block").mapInArrow(run, rows.selectExpr("cast(node as bigint) node", *names).schema)


def _faced(own: DataFrame, moving: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Rows by blocks of ``dst``: first the block's own rows (no ``targets``), then the rows of ``moving`` with the targets they have there."""
    blocks = _blocks(own.sparkSession, size)
    there = own.withColumn("block", _block("node", blocks))
    return there.unionByName(_sent(moving, pairs, blocks), allowMissingColumns=True).repartitionById(blocks, "block").sortWithinPartitions(F.col("targets").isNotNull())


def compared(pairs: DataFrame, vectors: DataFrame, names: list[str], work, out: str) -> DataFrame:
    """``src, dst`` and the columns ``out`` (doubles) of ``work(left, right)``: dicts of matrices, a row a pair, of the columns ``names``
    of both ends. Pairs with an end that has no row in ``vectors(node, ...)`` are left out."""
    rows = vectors.select("node", *names)
    met = _faced(rows, rows, pairs, _width(rows, names)).select("node", "targets", *names)
    columns = [c.split()[0] for c in out.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, state = [], {c: [] for c in names}, None
        for batch in batches:
            first = batch.column("targets").null_count
            if first:
                mine = batch.slice(0, first)
                ids.append(mine.column("node").to_numpy())
                for c in names:
                    own[c].append(_matrix(mine, c).copy())
                batch = batch.slice(first)
            if not batch.num_rows or not ids:
                continue
            if state is None:
                ids = [np.concatenate(ids)]
                order = np.argsort(ids[0], kind="stable")
                ids, state = [ids[0][order]], {c: np.concatenate(own.pop(c))[order] for c in names}
            flat, lengths = _split(batch.column("targets"))
            of, nodes = np.repeat(np.arange(batch.num_rows), lengths), batch.column("node").to_numpy()
            there = np.minimum(np.searchsorted(ids[0], flat), len(ids[0]) - 1)
            known = ids[0][there] == flat
            of, there = of[known], there[known]
            values = {c: _matrix(batch, c) for c in names}
            step = max(1, CHUNK // max(1, sum(v.shape[1] for v in values.values())))
            for a in range(0, len(of), step):
                x, y = of[a : a + step], there[a : a + step]
                made = work({c: v[x] for c, v in values.items()}, {c: v[y] for c, v in state.items()})
                yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(ids[0][y]), *[pa.array(m) for m in made]], ["src", "dst", *columns])

    return met.mapInArrow(run, f"src bigint, dst bigint, {out}")


def _lists(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``node, list`` (and ``weight``, an element each): the targets ``dst`` of each node, as ints where ids are small enough."""
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    kind = "int" if low is None or (low >= -(1 << 31) and high < 1 << 31) else "bigint"
    own = F.col("dst").cast(kind)
    if not weighted:
        return edges.groupBy(F.col("src").alias("node")).agg(F.collect_list(own).alias("list"))
    both = edges.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct(own.alias("dst"), "w")).alias("x"))
    return both.select("node", F.col("x.dst").alias("list"), F.col("x.w").alias("weight"))


def _marked(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[tuple]:
    """For each list that is sent here, and a part of its targets: its node, the targets, how many elements (and what weight of
    elements) of each target's own list are in it, and these elements. A list is marked once, and its targets' lists look there."""
    nodes, lists, sizes, weights, state = [], [], [], [], None
    for batch in batches:
        first = batch.column("targets").null_count
        if first:
            mine = batch.slice(0, first)
            flat, lengths = _split(mine.column("list"))
            nodes.append(mine.column("node").to_numpy().copy())
            lists.append(flat.copy())
            sizes.append(lengths)
            if weighted:
                weights.append(_split(mine.column("weight"))[0].copy())
            batch = batch.slice(first)
        if not batch.num_rows or not nodes:
            continue
        if state is None:
            ids, size = np.concatenate(nodes), np.concatenate(sizes)
            order = np.argsort(ids, kind="stable")
            start = (np.cumsum(size) - size)[order]
            elements, place = np.unique(np.concatenate(lists), return_inverse=True)
            place, weight = place.astype(np.int32), np.concatenate(weights) if weighted else None
            state, ids, size, marks = True, ids[order], size[order], np.zeros(len(elements), bool)
            lists = sizes = weights = None
        flat, lengths = _split(batch.column("list"))
        at = np.minimum(np.searchsorted(elements, flat), len(elements) - 1)
        known = elements[at] == flat
        upto = np.cumsum(lengths)
        asked, counts = _split(batch.column("targets"))
        there = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        real = ids[there] == asked
        ends = np.cumsum(counts)
        for r, node in enumerate(batch.column("node").to_numpy()):
            own = slice(upto[r] - lengths[r], upto[r])
            mark = at[own][known[own]]
            mine = slice(ends[r] - counts[r], ends[r])
            target = there[mine][real[mine]]
            if not len(mark) or not len(target):
                continue
            marks[mark] = True
            total = np.cumsum(size[target])
            cut = [0, *np.flatnonzero(np.diff(total // CHUNK)) + 1, len(target)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = target[a:b]
                length = size[part]
                segment = np.cumsum(length) - length
                where = np.repeat(start[part] - segment, length) + np.arange(length.sum())
                spot = place[where]
                hit = marks[spot]
                shared = np.add.reduceat(hit, segment, dtype=np.int64)
                yield node, ids[part], shared, np.add.reduceat(hit * weight[where], segment) if weighted else None, elements[spot[hit]]
            marks[mark] = False


def overlaps(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, cn, ra`` of the pairs whose ends share targets of ``edges(src, dst, w)``: how many, and the sum of the weights
    that ``dst`` gives them. A node's list is sent once to each block of its ``dst``."""
    own, moving = _lists(edges, weighted=True), _lists(edges)
    met = _faced(own, moving, pairs, 16 * edges.count()).select("node", "list", "weight", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["src", "dst", "cn", "ra"])

        for node, targets, shared, weight, _ in _marked(batches, True):
            some = shared > 0
            if not some.any():
                continue
            rows.append((np.full(int(some.sum()), node), targets[some], shared[some], weight[some]))
            held += len(rows[-1][0])
            if held >= 65536:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return met.mapInArrow(run, "src bigint, dst bigint, cn bigint, ra double")


def triangle_counts(out: DataFrame) -> DataFrame:
    """``node, triangles``, several rows a node, from edges that point one way without a cycle: a triangle is an edge whose ends share a target."""
    lists = _lists(out)
    met = _faced(lists, lists, out, 12 * out.count()).select("node", "list", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def summed():
            found, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            return found, np.bincount(place, np.concatenate([r[1] for r in rows])).astype(np.int64)

        for node, targets, shared, _, elements in _marked(batches, False):
            full = shared > 0
            if full.any():
                rows += [(targets[full], shared[full]), (np.array([node]), np.array([shared.sum()])), (elements.astype(np.int64), np.ones(len(elements), np.int64))]
                held += len(elements)
            if held >= CHUNK:
                rows = [summed()]
                held = len(rows[0][0])
                if held >= CHUNK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[0]], ["node", "triangles"])
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], ["node", "triangles"])

    return met.mapInArrow(run, "node bigint, triangles bigint")
