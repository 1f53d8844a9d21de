"""Resharding by minimum-cost flow: fill new shards from old ones, moving the fewest bytes.

Rows of an old shard fall into blocks by size class (half an octave). The flow network
has one node a block, one a new shard and one hub: staying in the own shard costs
nothing, passing the hub costs the block's mean bytes a row, and each new shard takes
the capacity the law allows. The network's size depends on shards and size classes,
never on rows, and the driver solves it by successive shortest paths. Of a block that
is cut the largest rows stay: a histogram of exact sizes says where to cut, so what
moves are an old shard's smallest rows.

Rows are numbered by prefix sums: within parts of about PART_ROWS rows, over the parts
of GROUP_PARTS, and over those groups. A block is never sorted whole, however many
rows it has, and equal rows are spread like others.

Laws: ``rows`` (counts differ by one at most; exact) and ``bytes`` (each block
goes where capacity in bytes is left; a cut block is divided by its mean).

Defined results for odd rows: a null text has no bytes and still counts as a row
(size 16); a null id or shard key is a value of its own; repeated rows are rows
of their own and get places of their own; other columns ride along untouched in
``rewrite`` and are ignored by ``plan``; an empty table gives an empty plan.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Bytes a row weighs besides its text, rows a numbered part holds (about), and parts of a group of parts.
ROW_BYTES, PART_ROWS, GROUP_PARTS = 16, 1000, 1024
_BLOCK = ["old", "size_class"]


class Flow:
    """Minimum-cost flow by successive shortest paths with node potentials (small, integer networks)."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Send all that fits at the least cost; returns the cost."""
        n, total, potential = len(self.edges), 0, [0] * len(self.edges)
        while True:
            dist, via, heap = [None] * n, [-1] * n, [(0, source)]
            dist[source] = 0
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.edges[a]:
                    if self.room[e] > 0:
                        b, nd = self.to[e], d + self.cost[e] + potential[a] - potential[self.to[e]]
                        if dist[b] is None or nd < dist[b]:
                            dist[b], via[b] = nd, e
                            heapq.heappush(heap, (nd, b))
            if dist[sink] is None:
                return total
            potential = [p + (d if d is not None else dist[sink]) for p, d in zip(potential, dist, strict=True)]
            sent, b = None, sink
            while b != source:
                e = via[b]
                sent, b = self.room[e] if sent is None else min(sent, self.room[e]), self.to[e ^ 1]
            b = sink
            while b != source:
                e = via[b]
                self.room[e] -= sent
                self.room[e ^ 1] += sent
                total, b = total + sent * self.cost[e], self.to[e ^ 1]


@dataclass
class Block:
    """Rows of one old shard and size class: how many, and their bytes."""

    old: int
    size_class: int
    rows: int
    size: int
    #: Runs of the block's rows: (first row, new shard, rows).
    runs: list[tuple[int, int, int]] = field(default_factory=list)


def solve(blocks: list[Block], n_new: int, law: str = "rows") -> int:
    """Give every block its runs; returns the bytes the plan moves (by the blocks' means)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    weight = [b.rows if law == "rows" else b.size for b in blocks]
    total = sum(weight)
    base, over = divmod(total, n_new)
    source, hub, extra, sink = 0, 1, 2, 3
    net = Flow(4 + n_new + len(blocks))
    stay, move = {}, []
    for k, b in enumerate(blocks):
        node = 4 + n_new + k
        price = -(-b.size // max(b.rows, 1)) if law == "rows" else 1
        net.add(source, node, weight[k], 0)
        if 0 <= b.old < n_new:
            stay[k] = net.add(node, 4 + b.old, weight[k], 0)
        move.append(net.add(node, hub, weight[k], price))
    inflow = [net.add(hub, 4 + j, total, 0) for j in range(n_new)]
    for j in range(n_new):
        net.add(4 + j, sink, base, 0)
        net.add(4 + j, extra, 1, 0)
    net.add(extra, sink, over, 0)
    net.run(source, sink)
    wanted = [[j, net.room[e ^ 1]] for j, e in enumerate(inflow)]
    moved, at = 0, 0
    for k, b in enumerate(blocks):
        kept, left = (net.room[stay[k] ^ 1] if k in stay else 0), net.room[move[k] ^ 1]
        units = weight[k]
        row = 0
        takes = [(b.old, kept)] if kept else []
        while left:
            while not wanted[at][1]:
                at += 1
            take = min(left, wanted[at][1])
            wanted[at][1] -= take
            left -= take
            takes.append((wanted[at][0], take))
        done = 0
        for shard, take in takes:
            done += take
            until = done if law == "rows" else round(b.rows * done / max(units, 1))
            if until > row:
                b.runs.append((row, shard, until - row))
                moved += b.size * (until - row) // max(b.rows, 1) if shard != b.old else 0
                row = until
        if row < b.rows:  # all rows are placed, whatever rounding did
            shard = takes[-1][0] if takes else 0
            b.runs.append((row, shard, b.rows - row))
    return moved


def measured(df: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow table of the rows: id, size, CRC-32 of the text, old shard (null: -1), size class, a hash to spread by."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old"),
        F.monotonically_increasing_id().alias("seen"),
    ).select("doc_id", "size", "text_crc32", "old", F.floor(F.log2("size") * 2).cast("int").alias("size_class"), F.xxhash64("doc_id", "text_crc32", "size", "seen").alias("mix"))


def _cuts(rows: DataFrame, blocks: list[Block]) -> DataFrame:
    """For each block that is cut: ``co, cc, cut``, the size of the last row that stays. A row a block."""
    spark = rows.sparkSession
    split = [(b.old, b.size_class, b.runs[0][2]) for b in blocks if len(b.runs) > 1 and b.runs[0][1] == b.old]
    wanted = spark.createDataFrame(split, "co int, cc int, stay long")
    # an old shard has one such block, and a size class few exact sizes
    sizes = rows.join(F.broadcast(wanted), (F.col("old") == F.col("co")) & (F.col("size_class") == F.col("cc"))).groupBy("co", "cc", "stay", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("co", "cc").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("upto", upto).where("upto >= stay").groupBy("co", "cc").agg(F.max("size").alias("cut"))


def plan(rows: DataFrame, n_new: int, law: str = "rows") -> DataFrame:
    """Each row of ``measured`` with its new ``shard``, gapless ``slot`` and ``law``. ``rows`` is read four times."""
    spark = rows.sparkSession
    found = rows.groupBy(*_BLOCK).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    found = found.orderBy(F.desc("size_class"), "old").collect()  # under 100 rows an old shard
    blocks = [Block(r["old"], r["size_class"], r["n"], r["size"]) for r in found]
    solve(blocks, n_new, law)
    slots, runs = [0] * n_new, []
    for b in blocks:
        for row, shard, n in b.runs:
            runs.append((b.old, b.size_class, row, row + n, shard, slots[shard] - row))
            slots[shard] += n
    by_block = spark.createDataFrame(runs, "o int, c int, first long, until long, shard int, shift long").groupBy("o", "c").agg(F.collect_list(F.struct("first", "until", "shard", "shift")).alias("runs"))
    parts = max(1, -(-sum(b.rows for b in blocks) // PART_ROWS))
    part = F.pmod(F.col("mix"), F.lit(parts))
    if law == "rows":  # rows above the cut come first, those below it last
        met = rows.join(F.broadcast(_cuts(rows, blocks)), (F.col("old") == F.col("co")) & (F.col("size_class") == F.col("cc")), "left")
        side = F.when(F.col("size") > F.col("cut"), 0).when(F.col("size") < F.col("cut"), 2).otherwise(F.when(F.col("cut").isNull(), 0).otherwise(1))
    else:
        met, side = rows, F.lit(0)
    dealt = met.select(*rows.columns, side.alias("side"), part.alias("part"))
    key = [*_BLOCK, "side", "part"]
    n_of = dealt.groupBy(*key).agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP_PARTS))
    of_groups = n_of.groupBy(*_BLOCK, "side", "group").agg(F.sum("n").alias("m"))
    of_groups = of_groups.withColumn("base", F.coalesce(F.sum("m").over(Window.partitionBy(*_BLOCK).orderBy("side", "group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*_BLOCK, "side", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = n_of.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(of_groups.drop("m"), [*_BLOCK, "side", "group"])
    starts = starts.select(*key, (F.col("base") + F.col("within")).alias("start"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("mix")) - 1
    placed = dealt.withColumn("nth", nth).join(starts, key).withColumn("nth", F.col("nth") + F.col("start"))
    joined = placed.join(F.broadcast(by_block), (F.col("old") == F.col("o")) & (F.col("size_class") == F.col("c")))  # a row a block
    run = F.expr("element_at(filter(runs, r -> r.first <= nth AND nth < r.until), 1)")
    return joined.withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.nullif("old", F.lit(-1)).alias("old"), F.lit(law).alias("law"), F.col("run.shard").alias("shard"), (F.col("run.shift") + F.col("nth")).cast("long").alias("slot")
    )


def reshard(df: DataFrame, old_shard: Column, n_new: int, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plan for a table: a measured row for each row of ``df``, with its place.

    The narrow table is written once, so that all passes read the same rows and the
    texts are scanned once.
    """
    return plan(written(measured(df, old_shard, id_col, text_col), "shard-rows"), n_new, law)


def rewrite(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the affected shards (those that gain or lose rows) as folders ``shard=N`` below ``path``, which
    must not exist: old files stay as they are, and a run that is lost midway leaves no ``_SUCCESS``.

    Rows keep all their columns; where one is called ``shard`` the folders are called ``shard_``, and so on.
    Ids must be unique here. Returns the shards written.
    """
    ends = placed.where("NOT (shard <=> old)").select(F.explode(F.array("shard", "old")).alias("s")).distinct()
    affected = sorted(r["s"] for r in ends.collect() if r["s"] is not None)  # shard numbers only
    folder = "shard"
    while folder in (c.lower() for c in df.columns):
        folder += "_"
    places = placed.where(F.col("shard").isin(affected)).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"))
    met = df.alias("d").join(places.alias("p"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("p.__id")))
    rows = met.select("d.*", F.col("p.__shard").alias(folder))
    rows.write.partitionBy(folder).parquet(path)
    return affected
