"""Neighbourhood sketches: MinHash signatures and HyperLogLog registers that merge along edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..shared import written
from .meeting import compared, gathered

HASHES, REGISTERS = 128, 256


def initial(nodes: DataFrame) -> DataFrame:
    """``node, mh, hll``: 128 minima and 256 registers of the node alone."""
    mh = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.conv(F.substring(F.md5(F.concat(F.lit("mh"), k.cast("string"), F.lit("|"), F.col("node").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"))
    d = draw("hll|", F.col("node"))
    rank = F.floor(F.lit(24) - F.floor(F.log2(F.greatest(F.floor(d / REGISTERS), F.lit(1)).cast("double"))))
    hll = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), lambda k: F.when(k == d % REGISTERS, rank).otherwise(0).cast("int"))
    return nodes.select("node", mh.alias("mh"), hll.alias("hll"))


#: Minima lie in [0, 2**32); moved down by this they are ints.
_HALF = 1 << 31


def _packed(sketch: DataFrame) -> DataFrame:
    """The sketch in 4 bytes a minimum and one a register, as it is sent."""
    return sketch.withColumns({"mh": F.transform("mh", lambda v: (v - _HALF).cast("int")), "hll": F.col("hll").cast("array<tinyint>")})


def propagate(sketch: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop: each node's sketch merged with its neighbours'. A sketch is sent once to each block of targets and merged
    where they are, so that no edge carries one."""
    looped = edges.select("src", "dst").unionByName(sketch.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    out = gathered(written(_packed(sketch.select("node", "mh", "hll")), "sketch-packed"), looped, {"mh": "min", "hll": "max"})
    return out.select("node", F.transform(F.col("mh").cast("array<bigint>"), lambda v: v + _HALF).alias("mh"), F.col("hll").cast("array<int>").alias("hll"))


def cardinality(hll: Column) -> Column:
    """HyperLogLog's estimate, by linear counting while registers are empty."""
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = alpha * m * m / F.aggregate(hll, F.lit(0.0), lambda a, r: a + F.pow(F.lit(2.0), -r.cast("double")))
    empty = F.size(F.filter(hll, lambda r: r == 0))
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw)


#: 2 to the power of less the register.
_POWERS = 2.0 ** -np.arange(128)


def _overlap(a: dict, b: dict, i: str, j: str) -> tuple[np.ndarray, np.ndarray]:
    """The share of equal minima of sketches ``i`` of the left ends and ``j`` of the right ones, and the estimated overlap."""
    share = (a[f"mh{i}"] == b[f"mh{j}"]).sum(1) / float(HASHES)
    union = np.maximum(a[f"hll{i}"], b[f"hll{j}"])
    m, empty = float(REGISTERS), (union == 0).sum(1)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / _POWERS[union].sum(1)
    few = (raw <= 2.5 * m) & (empty > 0)
    return share, share * np.where(few, m * np.log(m / np.maximum(empty, 1)), raw)


def intersections(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """``src, dst, jaccard, shared``: the estimated overlap of both neighbourhoods."""
    packed = written(_packed(sketch).select("node", F.col("mh").alias("mh1"), F.col("hll").alias("hll1")), "sketch-packed")
    return compared(pairs, packed, ["mh1", "hll1"], lambda a, b: _overlap(a, b, "1", "1"), "jaccard double, shared double")


def by_hop(nodes: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``node, hop, mh, hll, card``: a sketch for each node and number of steps up to ``hops``, written as it is made.
    Hop k merges the sketches of hop k - 1 over the neighbours and the node, so that it stands for all within k steps."""
    edges = written(edges.select("src", "dst"), "sketch-edges")
    level = written(initial(nodes), "sketch-hop")
    out = level.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        level = written(propagate(level, edges), "sketch-hop")
        out = out.unionByName(level.withColumn("hop", F.lit(hop)))
    return out.select("node", "hop", "mh", "hll", cardinality(F.col("hll")).alias("card"))


def structural_features(pairs: DataFrame, sketches: DataFrame, hops: int, zero_one: bool = True, floor: bool = False) -> DataFrame:
    """``src, dst, f0, ...``: for each pair estimated numbers of nodes by their distance to both ends, up to ``hops``.

    First come cells (i, j), nodes i steps from one end and j from the other, in the order (1,1), (2,1), (1,2), (2,2), (3,1), (1,3), (3,2),
    (2,3), (3,3); then for each distance d the nodes d steps from ``dst`` alone and from ``src`` alone. A cell is the overlap of
    both balls less the cells inside it; "alone" is the ball less the smaller ball and the cells at that distance. ``zero_one`` off
    sets to zero the pair of columns for nodes one step from one end alone (of three hops: columns 4 and 5, and two steps from one end alone), and
    ``floor`` sets negative estimates to zero.
    """
    steps = [str(h) for h in range(1, hops + 1)]
    packed = _packed(sketches.where(F.col("hop").between(1, hops)))
    by_node = packed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("hop", "mh", "hll", "card"))).alias("a"))  # a row a hop
    wide = [F.col("a")[k][c].alias(f"{c}{h}") for k, h in enumerate(steps) for c in ("mh", "hll")]
    wide = written(by_node.select("node", *wide, F.transform("a", lambda x: x["card"]).alias("card")), "sketch-wide")
    cells = [(1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (3, 2), (2, 3), (3, 3)][: hops * hops]

    def work(a: dict, b: dict) -> list:
        return [*[_overlap(a, b, str(i), str(j))[1] for i, j in cells], *[side["card"][:, k] for side in (a, b) for k in range(hops)]]

    out = ", ".join([*[f"o{i}{j} double" for i, j in cells], *[f"{side}{h} double" for side in "ab" for h in steps]])
    known = compared(pairs.select("src", "dst").distinct(), wide, wide.columns[1:], work, out)
    column: dict[tuple, Column] = {}
    for i, j in cells:
        inside = [column[c] for c in cells if c != (i, j) and c[0] <= i and c[1] <= j]
        column[i, j] = F.col(f"o{i}{j}") - sum(inside, F.lit(0.0))
    alone = []
    for d in range(1, hops + 1):
        for side in "ba":
            at = 1 if side == "b" else 0
            within = [c for c in cells if c[at] <= d]
            if (side, d, hops) == ("a", 2, 3):  # fixed: here the published features take off cell (3, 1) and not (1, 3)
                within = [(3, 1) if c == (1, 3) else c for c in within]
            seen = [column[c] for c in within] + [c for s, c in alone if s == side]
            alone.append((side, F.col(f"{side}{d}") - sum(seen, F.lit(0.0))))
    features = [*column.values(), *[c for _, c in alone]]
    if not zero_one:
        for k in {2: (4, 5), 3: (4, 5, 11, 12)}.get(hops, ()):
            features[k] = F.lit(0.0)
    if floor:
        features = [F.greatest(f, F.lit(0.0)) for f in features]
    return known.select("src", "dst", *[f.alias(f"f{k}") for k, f in enumerate(features)])
