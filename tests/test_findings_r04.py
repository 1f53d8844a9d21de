"""What the findings of round 4 were about, on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms, batches, generate, links, meeting, messages, statistics, tabular
from graphloom.sources import texts


def test_tokens_of_one_place_go_by_token(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else tokens so few meet in one partition, in order
    rows = [(0, 7, f"e{k}", "r0", f"e{(k * 5) % 40}") for k in range(40)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        found = {r.token: r.id for r in texts.vocabulary(spark.createDataFrame(rows, "file int, line_no long, h string, r string, t string").repartition(3)).collect()}
        assert found == {token: k for k, token in enumerate(sorted(found))}
    spark.conf.set("spark.sql.adaptive.enabled", before)


def _random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(a, b) for _ in range(m) for a, b in [(rng.randrange(n), rng.randrange(n))] if a != b})


@pytest.mark.parametrize("chunk", [1 << 21, 16])
def test_gathered_and_compared(spark, monkeypatch, chunk):
    """Against a loop over edges; a small CHUNK and STATE part blocks and batches."""
    monkeypatch.setattr(meeting, "CHUNK", chunk)
    monkeypatch.setattr(meeting, "STATE", 200)
    edges = [(a * 3 - 20, b * 3 - 20) for a, b in _random_edges(1, 30, 90)]
    ids = sorted({x for e in edges for x in e} | {1000})
    rng = random.Random(2)
    x = {v: ([rng.uniform(-1, 1) for _ in range(3)], [rng.randrange(-9, 9) for _ in range(2)], [rng.randrange(9)]) for v in ids}
    vectors = spark.createDataFrame([(v, *row) for v, row in x.items()], "node long, a array<double>, b array<int>, c array<tinyint>")
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r for r in meeting.gathered(vectors, df, {"a": "sum", "b": "min", "c": "max"}).collect()}
    assert got.keys() == {b for _, b in edges}
    for v, r in got.items():
        near = [x[a] for a, b in edges if b == v]
        assert r.a == pytest.approx([sum(n[0][k] for n in near) for k in range(3)])
        assert r.b == [min(n[1][k] for n in near) for k in range(2)] and r.c == [max(n[2][0] for n in near)]
    pairs = spark.createDataFrame([*edges, (5000, edges[0][1]), (edges[0][0], 5000)], "src long, dst long")
    both = meeting.compared(pairs, vectors, ["a", "b"], lambda p, q: [(p["a"] * q["a"]).sum(1), (p["b"][:, 0] - q["b"][:, 1]).astype(float)], "d double, e double").collect()
    assert sorted((r.src, r.dst) for r in both) == sorted(edges)
    assert all(r.d == pytest.approx(sum(p * q for p, q in zip(x[r.src][0], x[r.dst][0], strict=True))) and r.e == x[r.src][1][0] - x[r.dst][1][1] for r in both)


def test_smoothed_alike_for_whole_and_ragged_vectors(spark):
    """Vectors of one length go whole; a node with a longer vector turns that off, and must change nothing else."""
    edges = _random_edges(3, 20, 40)
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long").distinct()
    rows = [(v, [float(v % 5), 1.0 / (v + 1)]) for v in range(20)]
    whole, ragged = (tabular.smoothed(spark.createDataFrame(r, "k long, x array<double>"), df, "k", "x", 2) for r in (rows, [*rows, (99, [1.0, 2.0, 3.0])]))
    plan = whole._jdf.queryExecution().toString()
    found = {r.node: r.v for r in ragged.collect()}
    assert found.pop(99) == pytest.approx([1.0, 2.0, 3.0])
    assert {r.node: pytest.approx(r.v) for r in whole.collect()} == found and "collect_list" not in plan


def test_diameter_of_many_sources(spark):
    """More sources than a column has bits, many components, a node without edges; no row a source and node."""
    edges = [(a, a + 1) for k in range(0, 80, 8) for a in range(k, k + 7)] + [(200, 201)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    nodes = spark.createDataFrame([(v,) for v in [*range(80), 200, 201, 500]], "node long")
    row = algorithms.diameter(nodes, df, 1000, "s|").first()
    assert (row.diameter, row.sources, row.reached) == (7, 83, 10 * 8 * 8 + 2 * 2 + 1)


def test_four_cycles_by_landmarks(spark, monkeypatch):
    """Nodes are left for later rounds, and none is made up: the same for a last round alone and for all rounds."""
    for seed, limit in ((1, 10**6), (2, 3)):
        monkeypatch.setattr(links, "BROADCAST_EDGES", limit)
        one = _random_edges(seed, 40, 60)
        edges = sorted({*one, *((b, a) for a, b in one)})
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
        want = {a for a in near for c in near if a != c and len(near[a] & near[c]) > 1}
        for rounds in ((1,), (8, 2, 1)):
            monkeypatch.setattr(statistics, "LANDMARKS", rounds)
            got = [r.node for r in statistics.four_cycle_members(spark.createDataFrame(edges, "src long, dst long")).collect()]
            assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("layers", [2, 3, 4])
def test_messages_meet_halfway(spark, monkeypatch, layers):
    """The same states as without targets, and no state of (query, node) is written beyond half of the layers."""
    rng = random.Random(layers)
    edges = spark.createDataFrame([(rng.randrange(12), rng.randrange(2), rng.randrange(12)) for _ in range(30)], "src long, rel int, dst long")
    vectors = spark.createDataFrame([(0, 0.5, -1.5), (1, 2.0, 0.25)], "rel int, v0 double, v1 double")
    start = spark.createDataFrame([(q, rng.randrange(12), 1.0, rng.random()) for q in range(5) for _ in range(2)], "query int, node long, x0 double, x1 double").dropDuplicates(["query", "node"])
    targets = spark.createDataFrame([(q, v) for q in range(5) for v in range(0, 12, 2)], "query int, node long")
    want = {(r["query"], r.node): (r.x0, r.x1) for r in messages.relational_messages(start, edges, vectors, 2, layers).collect() if r.node % 2 == 0}
    made = []
    monkeypatch.setattr(messages, "written", lambda df, tag, keep=messages.written: made.append(tag) or keep(df, tag))
    got = {(r["query"], r.node): (r.x0, r.x1) for r in messages.relational_messages(start, edges, vectors, 2, layers, targets).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert made.count("message-state") == layers // 2


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_lists_meet_by_blocks(spark, monkeypatch, shift):
    """Common neighbours and triangles against sets, with small blocks and parts, ids beyond ints, and a hub."""
    monkeypatch.setattr(meeting, "STATE", 256)
    monkeypatch.setattr(meeting, "CHUNK", 32)
    one = [(a + shift, b + shift) for a, b in [*_random_edges(5, 25, 70), *[(24, v) for v in range(24)]]]
    edges = sorted({*one, *((b, a) for a, b in one)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    df = spark.createDataFrame(edges, "src long, dst long")
    asked = [(a + shift, b + shift) for a in range(27) for b in range(27)]
    got = {(r.src, r.dst): r for r in links.pair_scores(spark.createDataFrame(asked, "src long, dst long"), df).collect()}
    assert got.keys() == set(asked)
    for (a, b), r in got.items():
        both = near.get(a, set()) & near.get(b, set())
        assert (r.cn, r.pa) == (len(both), len(near.get(a, ())) * len(near.get(b, ()))) and r.ra == pytest.approx(sum(1 / len(near[m]) for m in both))
    tri = [(a, b, c) for a in near for b in near[a] for c in near[a] & near[b] if a < b < c]
    want = {v: sum(v in t for t in tri) for v in near if any(v in t for t in tri)}
    assert {r.node: r.triangles for r in statistics.triangles_by_node(df).collect()} == want


def test_pairs_are_drawn_once_and_by_digest(spark, monkeypatch):
    """All pairs in runs of few ids, each once, with the chances of ``uniform``; no pair is drawn twice as often as there are chances."""
    monkeypatch.setattr(generate, "_RUN", 4)
    drawn = {(u, v): int(hashlib.md5(f"s{u}|{v}".encode()).hexdigest()[:8], 16) / 2**32 for v in range(23) for u in range(v)}
    for p in (0.0, 0.3, 1.0):
        got = [tuple(r) for r in generate.bernoulli_pairs(spark, 23, p, "s").collect()]
        assert sorted(got) == sorted(e for e, x in drawn.items() if x < p)
    got = [tuple(r) for r in generate.label_blocks(spark, 23, 3, 0.5, 0.125, "s").collect()]
    assert sorted(got) == sorted((u, v) for (u, v), x in drawn.items() if x < (0.5 if u % 3 == v % 3 else 0.125))
    plan = generate.label_blocks(spark, 23, 3, 0.5, 0.125, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "conv(" not in plan


def test_kernel_graph_by_blocks(spark, monkeypatch):
    """Against all pairs: blocks of few vectors, products in parts, vectors of two lengths, nulls and a zero vector."""
    monkeypatch.setattr(generate, "_VECTORS", 4)
    monkeypatch.setattr(generate, "_PRODUCTS", 3)
    rng = random.Random(8)
    x = {k: [rng.uniform(-1, 1) for _ in range(3 if k % 5 else 2)] for k in range(45)} | {100: [0.0, 0.0, 0.0]}
    df = spark.createDataFrame([*x.items(), (101, [None, 1.0, 1.0]), (102, None)], "id long, x array<double>")
    want = {}
    for a in x:
        for b in x:
            if a < b and len(x[a]) == len(x[b]) and 100 not in (a, b):
                k = sum(p * q for p, q in zip(x[a], x[b], strict=True)) / (sum(p * p for p in x[a]) * sum(q * q for q in x[b])) ** 0.5
                if round(k, 6) >= 0.5:
                    want[a, b] = round(k, 6)
    got = {(r.a, r.b): r.k for r in generate.kernel_graph(df, "id", "x", 0.5).collect()}
    assert got == want


def test_bounded_distance_is_exact(spark):
    """Distances 0 to 5 on a sparse graph, against a search; pairs beyond and unknown nodes are null."""
    one = _random_edges(11, 40, 32)
    edges = sorted({*one, *((b, a) for a, b in one)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    asked = [(a, b) for a in range(0, 42, 3) for b in range(42)]
    for most in (1, 3, 5):
        got = {(r.src, r.dst): r.hops for r in algorithms.bounded_distance(spark.createDataFrame(asked, "src long, dst long"), spark.createDataFrame(edges, "src long, dst long"), most).collect()}
        for a in range(0, 42, 3):
            dist, level = {a: 0}, [a]
            while level:
                level = sorted({c for b in level for c in near.get(b, ()) if c not in dist})
                dist |= {c: dist.get(c, max(dist.values()) + 1) for c in level}
            assert all(got[a, b] == (dist[b] if dist.get(b, 99) <= most else None) for b in range(42))


def test_balls_that_overlap_share_a_round(spark, monkeypatch):
    """Leaves of a hub that is no target all reach each other: balls share them out, not one ball a round (12 rounds)."""
    edges = [(0, v) for v in range(1, 61)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    made = []
    monkeypatch.setattr(batches, "written", lambda df, tag, keep=batches.written: made.append(tag) or keep(df, tag))
    got = batches.proximity_batches(df, spark.range(1, 61).withColumnRenamed("id", "node"), 5, 2).collect()
    assert sorted(r.node for r in got) == list(range(1, 61)) and {(r.batch, r.place) for r in got} == {(b, p) for b in range(12) for p in range(5)}
    assert all(r.hop == (0 if r.seed == r.node else 2) for r in got) and made.count("batch-taken") <= 6
