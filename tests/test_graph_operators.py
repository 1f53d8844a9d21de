"""Micro graphs with known answers, and properties of draws, splits, scans and walks."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.functions.draws import draw
from graphloom.operators import algorithms as A
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import ranking as R
from graphloom.operators import scans
from graphloom.operators import splits as S
from graphloom.operators import statistics as ST
from graphloom.operators import walks as WK
from graphloom.sources import sinks, texts
from graphloom.streaming import running as RN


@pytest.fixture(scope="module")
def tadpole(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    return spark.range(6).toDF("node"), edges


def test_degrees_and_pointers(tadpole):
    nodes, edges = tadpole
    rows = {r["node"]: (r["degree"], r["start"]) for r in G.row_pointers(nodes, edges).collect()}
    assert rows == {0: (2, 0), 1: (2, 2), 2: (3, 4), 3: (2, 7), 4: (1, 9), 5: (0, 10)}


def test_pair_scores(spark, tadpole):
    _, edges = tadpole
    pairs = spark.createDataFrame([(0, 3), (2, 4), (0, 4)], "src long, dst long")
    got = {(r["src"], r["dst"]): (r["cn"], round(r["ra"], 6), r["pa"]) for r in L.pair_scores(pairs, edges).collect()}
    assert got == {(0, 3): (1, 0.333333, 4), (2, 4): (1, 0.5, 3), (0, 4): (0, 0.0, 2)}


def test_statistics(tadpole):
    nodes, edges = tadpole
    row = ST.clustering(nodes, edges).first()
    assert round(row["avg_clustering"], 6) == 0.388889 and row["triangles"] == 1
    assert {r["node"] for r in ST.triangles_by_node(edges).collect()} == {0, 1, 2}
    assert ST.cycle_members(edges, 4).count() == 0 and ST.cycle_members(edges, 5).count() == 0


def test_bfs_query_follows_long_chains(spark, tmp_path):
    from graphloom.plans import QUERIES

    spark.range(16).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame([(20 * k, k + end, end) for k in range(15) for end in (0, 1)], "l_orderkey long, l_partkey long, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["node"]: r["hop"] for r in QUERIES["it1_bfs_hops"](spark, str(tmp_path)).collect()} == {k: k for k in range(16)}


def test_diameter_is_the_greatest_eccentricity(spark):
    """The least node lies in a pair; a path of six lies elsewhere."""
    pairs = [(0, 1), *((a, a + 1) for a in range(2, 7))]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    assert tuple(A.diameter(spark.range(9).toDF("node"), edges, 200, "d|").first()) == (5, 9, 4 + 36 + 1)
    few = A.diameter(spark.range(9).toDF("node"), edges, 3, "d|").first()
    assert few["sources"] == 3 and few["diameter"] <= 5


def test_algorithms(tadpole):
    nodes, edges = tadpole
    assert {r["node"]: r["hop"] for r in A.hops(edges, nodes.where("node = 0")).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert {r["node"]: r["root"] for r in A.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    assert A.largest_component(nodes, edges).count() == 5
    rank = {r["node"]: round(r["rank"], 6) for r in A.pagerank(nodes, edges, 0.85, 3).collect()}
    assert rank == {0: 0.157355, 1: 0.157355, 2: 0.22897, 3: 0.190809, 4: 0.098844, 5: 0.025}


def test_walks_are_forced(spark, tadpole):
    nodes, edges = tadpole
    starts = nodes.select(F.col("node").alias("walk_id"), "node")
    paths = {r["walk_id"]: r["path"] for r in WK.walk(starts, edges, 4, "s", backtrack=False).collect()}
    assert paths[4][:3] == [4, 3, 2] and paths[4][3] in (0, 1) and paths[5] == [5] * 5
    known = {(r["src"], r["dst"]) for r in edges.collect()}
    for walk in WK.walk(starts, edges, 6, "s2", restart=0.5).collect():
        for k in range(1, 7):
            a, b, again = walk["path"][k - 1], walk["path"][k], walk["restarts"][k]
            assert b == walk["walk_id"] if again else (a, b) in known or a == b == 5
            assert not (again and walk["restarts"][k - 1])
    with pytest.raises(ValueError):
        WK.walk(starts, edges, 2, "s", restart=0.1, period=2)


def test_ranks_and_filters(spark):
    scores = spark.createDataFrame([(0, c, s) for c, s in enumerate((0.9, 0.8, 0.8, 0.5))], "qid int, cand int, score double")
    truth = spark.createDataFrame([(0, 2)], "qid int, cand int")
    for known, expected in ((None, (3, 2)), ([(0, 0)], (2, 1)), ([(0, 0), (0, 2)], (2, 1))):
        table = spark.createDataFrame(known, "qid int, cand int") if known else None
        assert tuple(R.true_ranks(scores, truth, table, t).first()["rank"] for t in ("pessimistic", "optimistic")) == expected


def test_recall_and_ndcg(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "src int, cand string, rank int")
    row = R.recall_at_k(ranked, spark.createDataFrame([(0, "b"), (0, "d")], "src int, cand string"), 3).first()
    assert (row["recall"], row["ndcg"]) == (0.5, round(0.63093 / 1.63093, 6))


def test_anonymised_text(spark):
    walks = spark.createDataFrame([([5, 9, 5, 7, 9, 2], [False, False, False, True, False, False])], "path array<long>, restarts array<boolean>")
    row = walks.select(X.first_seen(F.col("path")).alias("anon"), "restarts").select("anon", WK.as_text(F.col("anon"), F.col("restarts")).alias("text")).first()
    assert row["anon"] == [1, 2, 1, 3, 2, 4] and row["text"] == "1-2-1;3-2-4"


def test_multi_match_types(spark):
    triples = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (2, 0, 2)], "h long, r int, t long")
    places = spark.createDataFrame([(k, p, n) for k in range(60) for p, n in enumerate((0, 1))] + [(99, 0, 2), (99, 1, 2)], "walk_id long, pos int, node long")
    got = WK.step_types(places, triples, "m").where("pos = 1").collect()
    assert {(r["rel"], r["dir"]) for r in got if r["walk_id"] < 60} == {(0, 0), (1, 0), (0, 1)}
    assert [(r["rel"], r["dir"]) for r in got if r["walk_id"] == 99] == [(0, 2)]


def test_prefix_sums_cross_buckets(spark, monkeypatch):
    monkeypatch.setattr(scans, "BUCKET", 4)
    rows = scans.prefix_sum(spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")), "k", "v", "s").orderBy("k").collect()
    total = 0
    for r in rows:
        assert r["s"] == total
        total += r["v"]


def test_permutation_and_splits(spark):
    nodes = spark.range(500).toDF("node")
    order = S.permuted(nodes, "p|").collect()
    assert sorted(r["k"] for r in order) == list(range(500))
    by_draw = [r["node"] for r in nodes.orderBy(draw("p|", F.col("node")), "node").collect()]
    assert [r["node"] for r in sorted(order, key=lambda r: r["k"])] == by_draw
    assert S.fixed_split(nodes, 100, 0.2, "f|").groupBy("part").count().orderBy("part").collect() == [("test", 300), ("train", 100), ("val", 100)]


def test_undirected_bundle_has_no_leak(spark):
    rows = [(0, 1, "train"), (1, 0, "test"), (2, 1, "test"), (3, 3, "val"), (1, 2, "val")]
    got = {tuple(r) for r in G.undirected_bundle(spark.createDataFrame(rows, "src long, dst long, split string")).collect()}
    assert got == {(0, 1, "train"), (1, 0, "train"), (1, 2, "test"), (1, 2, "val")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x r1 y\n\nbad line\n y  r2 z \nx r1 z extra\n")
    found = texts.triples(texts.lines_of(spark, str(tmp_path / "a.txt")))
    assert [tuple(r) for r in texts.vocabulary(found).orderBy("id").collect()] == [("x", 0), ("y", 1), ("z", 2)]
    assert texts.parse_key("CORA:v2", {"Cora": ["v1", "v2"]}) == ("Cora", "v2")
    with pytest.raises(ValueError):
        texts.parse_key("Cora:v9", {"Cora": ["v1"]})
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = "file://" + str(tmp_path / "cache")
    for params in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert sinks.load_or_build(spark, path, params, build).count() == 3
    assert len(built) == 2


def test_resume_refuses_other_settings(spark):
    want = RN.fingerprint({"a": 1})
    same = spark.createDataFrame([(0, want, 7), (1, want, 5)], "worker int, fingerprint string, done int")
    assert RN.resume_point(same, want) == 5
    with pytest.raises(ValueError):
        RN.resume_point(same, RN.fingerprint({"a": 2}))


def test_registry():
    from graphloom.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 200


def test_neighbour_records(spark, tadpole):
    _, edges = tadpole
    walks = spark.createDataFrame([(0, [0, 1, 2, 3])], "walk_id long, path array<long>")
    got = WK.with_neighbours(walks, edges).orderBy("pos").collect()
    assert [(r["node"], r["anon"], r["is_nbr"]) for r in got] == [(0, 1, False), (1, 2, False), (2, 3, False), (0, 1, True)]


def test_npz_rows(spark, tmp_path):
    import numpy as np

    from graphloom.sources.arrays import read_npz

    np.savez(tmp_path / "g.npz", edges=np.array([[0, 1], [1, 2]]), labels=np.array([3, 4, 5]))
    got = sorted((r["name"], r["i"], r["values"]) for r in read_npz(spark, str(tmp_path / "g.npz")).collect())
    assert got == [("edges", 0, [0.0, 1.0]), ("edges", 1, [1.0, 2.0]), ("labels", 0, [3.0]), ("labels", 1, [4.0]), ("labels", 2, [5.0])]


def test_queue_order_and_bounded_distances(spark):
    """Against a queue over lists, with a budget that cuts a level, and all distances of small random graphs."""
    import random
    from collections import deque

    rng = random.Random(3)
    for n, m in ((12, 14), (40, 60)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        both = sorted(pairs | {(b, a) for a, b in pairs})
        near = {k: [b for a, b in both if a == k] for k in range(n)}
        edges = spark.createDataFrame(both, "src long, dst long")

        def queue(start):
            order, hop, waiting = [start], {start: 0}, deque([start])
            while waiting:
                a = waiting.popleft()
                for b in near[a]:
                    if b not in hop:
                        hop[b] = hop[a] + 1
                        order.append(b)
                        waiting.append(b)
            return order, hop

        order, hop = queue(both[0][0])
        seed = spark.createDataFrame([(both[0][0],)], "node long")
        for budget in (3, n // 2, 10 * n):
            got = {r["place"]: (r["node"], r["hop"]) for r in A.queue_order(edges, seed, budget).collect()}
            assert got == {k: (x, hop[x]) for k, x in enumerate(order[:budget])}
        asked = [(a, b) for a in range(0, n, 3) for b in range(n)]
        for most in (1, 3, 4):
            got = {(r["src"], r["dst"]): r["hops"] for r in A.bounded_distance(spark.createDataFrame(asked, "src long, dst long"), edges, most).collect()}
            assert got == {(a, b): d if (d := queue(a)[1].get(b)) is not None and d <= most else None for a, b in asked}


def test_personalised_pagerank_stops_at_its_tolerance(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3)], "src long, dst long")
    nodes = spark.range(5).toDF("node")
    out = {0: [1], 1: [0, 2], 2: [1, 3], 3: [], 4: []}
    for start in (None, {0: 1.0}):
        p = {k: 0.2 for k in out} if start is None else {k: start.get(k, 0.0) for k in out}
        rank = dict(p)
        while True:
            new = {k: 0.15 * p[k] + 0.85 * sum(rank[a] / len(out[a]) for a in out if k in out[a]) for k in out}
            moved = sum(abs(new[k] - rank[k]) for k in out)
            rank = new
            if moved < 1e-4:
                break
        begin = None if start is None else spark.createDataFrame(list(start.items()), "node long, p double")
        got = {r["node"]: r["rank"] for r in A.pagerank_until(nodes, edges, 0.85, 1e-4, begin).collect()}
        assert all(abs(got[k] - rank[k]) < 1e-12 for k in out)


def test_walk_arguments_exclude_each_other(spark):
    import pytest

    edges = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    starts = spark.createDataFrame([(0, 0)], "walk_id long, node long")
    for wrong in ({"restart": 0.2, "period": 3}, {"p": 2.0, "restart": 0.2}, {"q": 2.0, "backtrack": False}, {"p": 2.0, "weights": edges}, {"restart": 1.0}, {"period": -1}, {"p": 0.0}):
        with pytest.raises(ValueError):
            WK.random_walks(starts, edges, 2, "x", **wrong)
    assert WK.random_walks(starts, edges, 2, "x", p=2.0).first()["path"] == [0, 1, 0]


def test_samplers_by_their_moments(spark):
    from graphloom.functions import samplers as SA

    rows = spark.range(20000)
    key = ("s|", F.col("id"))
    forms = {  # the sampler, its mean and its variance
        "normal": (SA.normal(key, 2.0, 3.0), 2.0, 9.0),
        "gamma": (SA.gamma(key, 2.5, 2.0), 5.0, 10.0),
        "small gamma": (SA.gamma(key, 0.4), 0.4, 0.4),
        "beta": (SA.beta(key, 2.0, 3.0), 0.4, 0.04),
        "moved beta": (SA.beta(key, 2.0, 3.0, 1.0, 10.0), 5.0, 4.0),
        "half normal": (SA.truncated_normal(key, 0.0, 1.0, 0.0), 0.7979, 0.3634),
        "two modes": (SA.bimodal_normal(key, (10.0, 1.0), (20.0, 1.0), 0.25, 0.0, 100.0), 17.5, 19.75),
        "drawn shapes": (SA.gamma(key, SA.between(("g|", F.col("id") % 50), 1.0, 3.0)), 2.0, 2.33),
    }
    got = rows.agg(*[F.avg(c).alias(f"m {n}") for n, (c, _, _) in forms.items()], *[F.var_samp(c).alias(f"v {n}") for n, (c, _, _) in forms.items()]).first()
    for name, (_, mean, variance) in forms.items():
        loose = 0.3 if name == "drawn shapes" else 0.05
        assert abs(got[f"m {name}"] - mean) < max(loose * mean, 0.02), name
        assert abs(got[f"v {name}"] - variance) < max(3 * loose * variance, 0.02), name
    whole = rows.agg(F.min(SA.whole_gamma(key, 2.0, 3.0, 2, 9)).alias("a"), F.max(SA.whole_gamma(key, 2.0, 3.0, 2, 9)).alias("b"), F.min(SA.whole_log_between(key, 1, 64)).alias("c"), F.max(SA.whole_log_between(key, 1, 64)).alias("d")).first()
    assert tuple(whole) == (2, 9, 1, 64)


@pytest.mark.parametrize("backtrack", [True, False])
def test_walks_go_on_from_prefixes(spark, backtrack):
    edges = spark.createDataFrame([e for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 0), (5, 6)] for e in ((a, b), (b, a))], "src long, dst long")
    starts = spark.createDataFrame([(k, k % 8) for k in range(40)], "walk_id long, node long")
    whole = {r.walk_id: list(r.path) for r in WK.walk(starts, edges, 9, "s", backtrack=backtrack).collect()}
    cut = spark.createDataFrame([(k, p[: 1 + k % 10]) for k, p in whole.items()], "walk_id long, path array<long>")
    assert {r.walk_id: list(r.path) for r in WK.walk(cut, edges, 9, "s", backtrack=backtrack).collect()} == whole
    assert {r.walk_id: len(r.path) for r in WK.walk(cut, edges, 4, "s", backtrack=backtrack).collect()} == {k: max(5, 1 + k % 10) for k in whole}


def test_start_modes(spark):
    def nodes(ids):
        return spark.createDataFrame([(i,) for i in ids], "node long")

    train, batch, focus = range(5), range(10, 17), range(20, 23)
    for mode in WK.MODES:
        rows = WK.start_nodes(mode, nodes(train), nodes(batch), 7, 3, "s", nodes(focus)).collect()
        assert len({(r.refinement, r.slot) for r in rows}) == len(rows) == 63 and {r.refinement for r in rows} == {0, 1, 2}
        allowed = {"default": {*train, *batch}, "train_only": {*train}, "train_chunk": {*focus}, "batch_only": {*batch}}[mode]
        assert {r.node for r in rows} <= allowed
        if mode in ("train_chunk", "batch_only"):
            for t in range(3):
                counts = [sum(r.node == n and r.refinement == t for r in rows) for n in allowed]
                assert max(counts) - min(counts) <= 1
    assert len(WK.start_nodes("default", nodes(train), nodes(batch), 7, 3, "s", short=True).collect()) == 2 * 31 + 32
    with pytest.raises(ValueError, match="train_chunk"):
        WK.start_nodes("train_chunk", nodes(train), nodes(batch), 7, 3, "s")
    assert WK.start_nodes("batch_only", nodes(train), nodes([]), 7, 3, "s").count() == 0
