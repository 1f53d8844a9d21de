"""Quantile grids, categorical plans, singular vectors and bridges against NumPy and plain versions."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms, scans, tabular


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "node long, x double").repartition(3)


def plain_transform(grid, x):
    refs = np.linspace(0, 1, len(grid))
    y = 0.5 * (np.interp(x, grid, refs) - np.interp(-x, -grid[::-1], -refs[::-1]))
    return np.where(x - 1e-7 < grid[0], 0.0, np.where(x + 1e-7 > grid[-1], 1.0, y))


@pytest.mark.parametrize(("n", "kinds"), [(700, 10**6), (400, 6), (45, 3), (7, 10), (1, 1), (300, 1)])
def test_quantile_grid(spark, n, kinds):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 3), 6) if kinds > 100 else float(rng.randrange(kinds)) for _ in range(n)]
    df = column(spark, [*values, None, float("nan")])
    grid = tabular.quantile_grid(df, "x")
    k = tabular.knots(n)
    want = np.quantile(values, np.linspace(0, 1, k)) if k > 1 else np.array(values)
    assert np.allclose(grid.first()[0], want, atol=1e-12)
    for normal in (False, True):
        got = {r.node: r.q for r in tabular.quantile_transform(df, "x", "q", grid, normal).collect()}
        assert got[n] is None and got[n + 1] != got[n + 1]
        expected = plain_transform(want, np.array(values))
        for i, p in enumerate(expected):
            if normal:
                p = NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7))
            assert got[i] == pytest.approx(p, abs=1e-7)


def test_inverse_normal(spark):
    ps = [1e-7, 1e-4, 0.02425, 0.024251, 0.3, 0.5, 0.77, 0.97575, 0.999, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(tabular.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=2e-9, abs=1e-12)


def test_plan(spark):
    rng = random.Random(2)
    names = [f"c{k}" for k in range(6)]
    rows = [(i, *[rng.choice([None, rng.gauss(0, 1)]) if k == 5 else rng.gauss(0, 1) for k in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} double" for n in names))
    plan = tabular.category_plan(names, "s", 0.7, 6)
    assert sorted(p.column for p in plan) == names and sum(p.kind != "kept" for p in plan) == 4
    assert plan == tabular.category_plan(names, "s", 0.7, 6) != tabular.category_plan(names, "t", 0.7, 6)
    out = tabular.categorised(df, "node", plan, "s", 6).collect()
    width = sum(len(p.classes) if p.kind == "onehot" else 1 for p in plan)
    assert len(out) == 60 and len(out[0]) == width + 1
    cut_rows = sorted(rows, key=lambda r: (tabular.drawn("s|row|", r[0]), r[0]))[:5]
    places = {k: i for i, k in enumerate(tabular.shuffled(list(range(width)), "s|order"))}
    for row, got in zip(rows, sorted(out, key=lambda r: r.node), strict=True):
        at = 0
        for p in plan:
            x = row[1 + names.index(p.column)]
            cuts = [cut_rows[k][1 + names.index(p.column)] for k in p.cuts]
            kind = None if x is None else p.classes[sum(x > c for c in cuts if c is not None)] if p.kind != "kept" else None
            for c in range(len(p.classes) if p.kind == "onehot" else 1):
                want = x if p.kind == "kept" else float(kind == c) if p.kind == "onehot" else kind
                assert got[1 + places[at]] == want
                at += 1


@pytest.mark.parametrize(("n", "d", "rank", "k"), [(300, 12, 12, 5), (40, 20, 3, 6), (3, 5, 5, 4)])
def test_singular_vectors(spark, n, d, rank, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, rank)) @ np.diag(2.0 ** -np.arange(rank)) @ rng.normal(size=(rank, d))
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "node long, v array<double>").repartition(5)
    rows, values = tabular.truncated_svd(df, "node", "v", k)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = np.pad(s, (0, max(0, k - len(s))))[: len(values)]
    assert np.allclose(values, want, atol=1e-6 * s[0])
    got = np.array([r.u for r in rows.orderBy("node").collect()])
    good = min(k, rank, n)
    signs = np.sign(vt[:good][np.arange(good), np.abs(vt[:good]).argmax(1)])
    assert np.allclose(got[:, :good], (u * s)[:, :good] * signs, atol=1e-5 * s[0])


def test_numbers_within_groups(spark, monkeypatch):
    monkeypatch.setattr(scans, "BUCKET", 4)
    rows = [(g, k) for g in range(3) for k in random.Random(g).sample(range(40), 20 - 9 * g)]
    got = scans.numbered_within(spark.createDataFrame(rows, "g long, k long"), "g", "k", "i").collect()
    for g in range(3):
        own = sorted(k for h, k in rows if h == g)
        assert {r.k: r.i for r in got if r.g == g} == {k: i for i, k in enumerate(own)}


def test_bridges(spark):
    nodes = spark.range(30).withColumnRenamed("id", "node")
    chain = [(a, a + 1) for a in range(0, 9)] + [(12, 13), (14, 15), (15, 16)]
    edges = spark.createDataFrame([e for a, b in chain for e in ((a, b), (b, a))], "src long, dst long")
    new = algorithms.bridges(nodes, edges, "s|", share=0.5).collect()
    assert len(new) == 6 and all(r.u <= 9 < r.v for r in new)
    whole = algorithms.bridged(nodes, edges, "s|", share=0.5)
    before, after = {tuple(r) for r in edges.collect()}, [tuple(r) for r in whole.collect()]
    assert before <= set(after) and all((b, a) in after for a, b in after)
    assert algorithms.largest_component(nodes, whole).count() > 15
    tied = spark.createDataFrame([(a, b) for a in range(30) for b in (a - 1, a + 1) if 0 <= b < 30], "src long, dst long")
    assert algorithms.bridges(nodes, tied, "s|").count() == 0 and algorithms.bridged(nodes, tied, "s|").count() == tied.count()
