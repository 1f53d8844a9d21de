"""Proximity batches, relational messages and sketch features against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import batches, links, messages, sketches, statistics


def graph(seed, n, m):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def plain_greedy(edges, targets, size, radius):
    """One ball after another around the uncovered node of largest degree; layers by id."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    uncovered, done, current = set(targets), [], []
    while uncovered:
        seed = min(uncovered, key=lambda v: (-len(near.get(v, ())), v))
        seen, layer, hop = {seed}, [seed], 0
        while layer:
            for v in sorted(layer):
                if v in uncovered and len(current) < size:
                    uncovered.discard(v)
                    current.append(v)
            if len(current) == size:
                done.append(current)
                current = []
                break
            if hop == radius:
                break
            layer = {w for v in layer for w in near.get(v, ())} - seen
            seen |= layer
            hop += 1
    return done + ([current] if current else [])


@pytest.mark.parametrize(("seed", "n", "m", "size", "radius"), [(1, 14, 16, 4, 2), (2, 12, 8, 5, 8), (3, 16, 40, 6, 1)])
def test_one_by_one_is_the_plain_greedy(spark, seed, n, m, size, radius):
    edges, targets = graph(seed, n, m), [v for v in range(n) if v % 5]
    got = batches.proximity_batches(frame(spark, edges), spark.createDataFrame([(v,) for v in targets], "node long"), size, radius, one_by_one=True).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.batch, r.place)):
        found.setdefault(r.batch, []).append(r.node)
    assert list(found.values()) == plain_greedy(edges, targets, size, radius)


@pytest.mark.parametrize(("n", "m", "size", "radius"), [(60, 70, 7, 2), (50, 300, 8, 3), (9, 0, 4, 2)])
def test_batches_are_a_division(spark, n, m, size, radius):
    edges, targets = graph(n, n, m), list(range(0, n, 2)) + [0]
    df = frame(spark, edges)
    got = batches.proximity_batches(df, spark.createDataFrame([(v,) for v in targets], "node long"), size, radius).collect()
    assert sorted(r.node for r in got) == sorted(set(targets))
    sizes = {}
    for r in got:
        sizes.setdefault(r.batch, set()).add(r.place)
    assert all(sizes[b] == set(range(size if b < max(sizes) else len(sizes[b]))) for b in sizes) and len(sizes) == -(-len(set(targets)) // size)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    for r in got:
        ball = {r.seed}
        for _ in range(r.hop):
            ball |= {w for v in ball for w in near.get(v, ())}
        assert r.node in ball and r.hop <= radius


def test_no_targets(spark):
    assert batches.proximity_batches(frame(spark, [(0, 1), (1, 0)]), spark.createDataFrame([], "node long"), 4).count() == 0


@pytest.mark.parametrize("options", [{}, {"short_cut": True}, {"activation": lambda c: F.greatest(c, F.lit(0.0))}])
def test_messages(spark, options):
    rng = random.Random(6)
    dims, layers = 2, 3
    edges = [(rng.randrange(7), rng.randrange(3), rng.randrange(7)) for _ in range(20)]
    vectors = {r: [rng.uniform(-1, 1) for _ in range(dims)] for r in range(3)}
    boundary = {("a", 0): [1.0, 2.0], ("a", 4): [0.5, -1.0], ("b", 3): [1.0, 1.0]}
    state = dict(boundary)
    for _ in range(layers):
        out = {k: list(v) for k, v in boundary.items()}
        if options.get("short_cut"):
            for k, v in state.items():
                out[k] = [x + y for x, y in zip(out.get(k, [0.0] * dims), v, strict=True)]
        for (q, node), x in state.items():
            for s, r, d in edges:
                if s == node:
                    out[q, d] = [o + a * w for o, a, w in zip(out.get((q, d), [0.0] * dims), x, vectors[r], strict=True)]
        state = {k: [max(x, 0.0) for x in v] if "activation" in options else v for k, v in out.items()}
    df = spark.createDataFrame(edges, "src long, rel int, dst long")
    vecs = spark.createDataFrame([(r, *v) for r, v in vectors.items()], "rel int, v0 double, v1 double")
    start = spark.createDataFrame([(q, n, *x) for (q, n), x in boundary.items()], "query string, node long, x0 double, x1 double")
    targets = spark.createDataFrame([("a", 2), ("a", 4), ("b", 6), ("b", 6), ("c", 1)], "query string, node long")
    for asked in (None, targets):
        got = {(r["query"], r.node): (r.x0, r.x1) for r in messages.relational_messages(start, df, vecs, dims, layers, asked, **options).collect()}
        want = {k: v for k, v in state.items() if asked is None or k in {("a", 2), ("a", 4), ("b", 6), ("c", 1)}}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_features_are_near_exact_counts(spark):
    """Estimates against exact counts: within what 128 minima and 256 registers allow."""
    edges = frame(spark, graph(12, 150, 260))
    nodes = spark.range(150).withColumnRenamed("id", "node")
    pairs = spark.createDataFrame([(a, b) for a in range(0, 40, 2) for b in (a + 1, a + 50)], "src long, dst long")
    got = {(r.src, r.dst): r for r in sketches.structural_features(pairs, sketches.by_hop(nodes, edges, 2), 2).collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    off = []
    for (a, b), r in got.items():
        one, two = ({v} | near.get(v, set()) for v in (a, b))
        far = [set().union(*[{w} | near.get(w, set()) for w in s]) for s in (one, two)]
        exact = [len(one & two), len((far[0] & two) - one), len((one & far[1]) - two), len((far[0] - one) & (far[1] - two)), len(two - far[0]), len(one - far[1])]
        off.append([getattr(r, f"f{k}") - e for k, e in enumerate(exact)])
    assert len(got) == 40 and all(sum(abs(o[k]) for o in off) / len(off) < 3.5 for k in range(6))
    zeroed = sketches.structural_features(pairs, sketches.by_hop(nodes, edges, 2), 2, zero_one=False, floor=True).collect()
    assert all(r.f4 == r.f5 == 0 and min(r[2:]) >= 0 for r in zeroed)


def test_four_cycles(spark):
    for seed in range(3):
        edges = graph(seed, 14, 20)
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
        want = {a for a in near for b in near[a] for c in near[b] - {a} for d in near[c] - {b} if a in near[d] and d != a}
        assert {r.node for r in statistics.cycle_members(frame(spark, edges), 4).collect()} == want


@pytest.mark.parametrize("limit", [10**6, 3])
def test_wedges_and_pairs_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(links, "BROADCAST_EDGES", limit)
    edges = graph(4, 20, 50)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    df = frame(spark, edges)
    want = {(a, c): near[a] & near[c] for a in near for b in near[a] for c in near[b] if c != a}
    got = {(r.src, r.cand): r for r in links.wedge_scores(df).collect()}
    assert {k: r.cn for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k].ra == pytest.approx(sum(1 / len(near[m]) for m in v)) for k, v in want.items())
    fresh = links.wedge_scores(df, spark.createDataFrame([(3,), (5,)], "src long"), known=df).collect()
    assert {(r.src, r.cand) for r in fresh} == {k for k in want if k[0] in (3, 5) and k not in set(edges)}
    pairs = spark.createDataFrame([(0, 5), (0, 5), (3, 9), (3, 99), (98, 99), (7, 7)], "src long, dst long")
    found = {(r.src, r.dst): r for r in links.pair_scores(pairs, df).collect()}
    for (a, b), r in found.items():
        both = near.get(a, set()) & near.get(b, set())
        assert (r.cn, r.pa) == (len(both), len(near.get(a, ())) * len(near.get(b, ()))) and r.ra == pytest.approx(sum(1 / len(near[m]) for m in both))
    assert len(found) == 5
