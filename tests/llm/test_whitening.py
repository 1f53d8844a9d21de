"""Whitening against plain integers and NumPy."""

import math
import random

import numpy as np
import pytest

from graphloom.llm import whitening


def frame(spark, rows, extra=False):
    schema = "vec_id long, embedding array<float>" + (", whitened string, __x int, deviation string" if extra else "")
    return spark.createDataFrame([(i, v, *(["w", 7, "d"] if extra else [])) for i, v in rows], schema)


def plain(vectors):
    """n, S, n XᵀX - S Sᵀ by integers of any length."""
    xs = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    m = [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return xs, n, s, m


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9, 1e16])
def test_scatter_is_exact(scale):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(1300, 5)) * scale + scale * 3).astype(np.int64)
    one, two = whitening.Scatter(5), whitening.Scatter(5)
    one.add(x[:700]), one.add(x[700:]), two.add(x[::-1])
    want = x.astype(object).T @ x.astype(object)
    for got in (one, two):
        got._close()
        assert (got.products == want).all() and list(got.sums) == list(x.astype(object).sum(0)) and got.n == 1300


def test_scatter_of_the_longest_integers():
    x = np.array([[2**63 - 1, -(2**63)], [5, 2**63 - 1], [-(2**63), -3]], np.int64)
    got = whitening.Scatter(2)
    got.add(x[1:2]), got.add(x[:1]), got.add(x[2:])
    got._close()
    assert (got.products == x.astype(object).T @ x.astype(object)).all()
    for value in (2**200 + 12345, -(2**130) - 1, 0):
        assert sum(v << (whitening.DIGIT * k) for _, _, k, v in whitening._digits(0, 0, value)) == value


def test_fit_and_rows(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(3, 1 + j) + (0.5 * i % 3) for j in range(6)] for i in range(300)]
    vectors += vectors[:40] + [vectors[7]] * 150  # repeated rows count once
    vectors = [[float(np.float32(c)) for c in v] for v in vectors]
    df = frame(spark, list(enumerate(vectors)), extra=True).repartition(7)
    model = whitening.fit(df)
    xs, n, s, m = plain(vectors)
    assert (model.n, list(model.sums)) == (n, s)
    values, vecs = np.linalg.eigh(np.array([[v / n**2 for v in row] for row in m]))
    values, vecs = values[::-1], vecs[:, ::-1]
    assert np.allclose(model.values, values[:4], rtol=1e-10) and model.identity_error < 1e-9
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-10)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "__x", "whitened", "deviation"]
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(vectors):
        x = [math.floor(256 * c) for c in v]
        assert got[i].deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) and got[i]["__x"] == 7
        want = np.array([a - b / n for a, b in zip(x, s, strict=True)]) @ vecs[:, :4] / np.sqrt(values[:4])
        assert np.allclose(np.abs(got[i].whitened), np.abs(want), atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, [1.0]), (7, [2.0, -1.0]), (7, [2.0, -1.0]), (None, [0.25, 0.5]), (9, [])]
    df = frame(spark, rows)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    assert model.n == 3 and sorted(str(r.vec_id) for r in got) == ["1", "7", "7", "None"]
    assert len(model.values) == 2 and all(len(r.whitened) == 2 for r in got)
    assert whitening.fit(df.limit(0)) is None and whitening.whiten(df, None).count() == 0
    one = whitening.fit(df.where("vec_id = 1"))
    assert one.n == 1 and one.identity_error is None
    assert [tuple(r.whitened) + (r.deviation,) for r in whitening.whiten(df.where("vec_id = 1"), one).collect()] == [(None, None, 0)]
    far = frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 1.0])])
    huge = whitening.fit(far)
    assert huge.sums[0] == (2**63 - 1) + (-(2**63)) + 256
    assert {r.vec_id: r.deviation for r in whitening.whiten(far, huge).collect()}[1] is None


def test_query_on_whole_table(spark, tmp_path):
    from graphloom.llm.queries import QUERIES

    frame(spark, [(1, [0.5, 1.0, 0.0]), (2, [1.5, -1.0, 0.0]), (3, None), (3, [2.5, 0.25, 0.0])]).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    assert len(rows) == 9 and {r.component for r in rows} == {1, 2, 3} and {r.n for r in rows} == {3}
    assert all((r.whitened is None) == (r.component == 3) for r in rows)  # a dimension without variance
    assert abs(sum(r.explained for r in rows if r.vec_id == 1) - 1) < 1e-9 and max(r.identity_error for r in rows) < 1e-9
    frame(spark, []).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    none = QUERIES["op11_whitening"](spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
