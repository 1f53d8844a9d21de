"""Suffix-array dedup against brute force, and its sort against sorted()."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import substrings, suffixes


def brute(texts, length):
    """Removed runs and kept bytes of each text, by all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(i, next((j for j in range(i, len(r)) if not gone[j]), len(r))) for i in range(len(r)) if gone[i] and (not i or not gone[i - 1])]
        out.append((runs, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


def made(rng, n, alphabet="abcé 漢"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def texts_of(rng, length, many):
    """Documents with shared passages, near copies, periodic stretches and whole copies."""
    passages = [made(rng, rng.randint(length // 2, 3 * length)) for _ in range(8)]
    texts = [None, "", "x" * (4 * length), "ab" * (2 * length), made(rng, length)]
    for _ in range(many):
        parts = [made(rng, rng.randint(0, length)) + rng.choice([*passages, ""]) for _ in range(rng.randint(0, 4))]
        texts.append("".join(parts) + made(rng, rng.randint(0, length)))
    base = made(rng, 6 * length)
    for _ in range(many // 2):
        at = rng.randrange(len(base))
        texts.append(base[:at] + made(rng, 1) + base[at + 1 :])
    return [*texts, texts[7], texts[7], base]


def held(spark, texts, ids=None, **options):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, k1 int, seed string, kept string").repartition(3)
    return [([tuple(x) for x in r.removed], bytes(r.kept), r.doc_id) for r in substrings.cut(df, **options).select("removed", "kept", "doc_id").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_sort(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") * rng.randint(1, 30) for _ in range(60)).encode() * 3
    length = rng.choice([5, 17, 64, 150])
    starts = np.array([rng.randrange(len(text) - length) for _ in range(500)])
    buckets = np.array([rng.randrange(4) for _ in range(500)])
    order, lcp = suffixes.sort_suffixes(text, starts, buckets, length, shallow=rng.choice([0, 8, 32]))
    strings = [(int(b), text[s : s + length]) for b, s in zip(buckets, starts, strict=True)]
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(500))
    for k in range(1, 500):
        (b, x), (c, y) = strings[order[k - 1]], strings[order[k]]
        assert lcp[k] == (len(os.path.commonprefix([x, y])) if b == c else 0)


def test_windows_choose_by_content():
    rng = random.Random(2)
    passage = made(rng, 300).encode()
    texts = [made(rng, rng.randint(0, 90)).encode() + passage + made(rng, 50).encode() for _ in range(3)]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    doc, place, _, lo, hi = substrings.seeds(np.frombuffer(b"".join(texts), np.uint8), bounds, 40)
    covered = sorted((int(d), s) for d, a, b in zip(doc, lo, hi, strict=True) for s in range(a, b + 1))
    assert covered == [(d, s) for d, t in enumerate(texts) for s in range(bounds[d], bounds[d] + len(t) - 39)]
    chosen = [{s - bounds[d] - texts[d].index(passage): p - s for dd, p, a, b in zip(doc, place, lo, hi, strict=True) if dd == d for s in range(a, b + 1)} for d in range(3)]
    assert all(chosen[0][s] == chosen[d][s] for d in (1, 2) for s in range(len(passage) - 39))


@pytest.mark.parametrize(("length", "group", "tile"), [(40, 256, 1 << 18), (40, 3, 64), (9, 2, 1 << 18)])
def test_against_brute_force(spark, monkeypatch, length, group, tile):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "TILE", tile)
    texts = texts_of(random.Random(length + group), length, 30)
    got = sorted(held(spark, texts, length=length), key=lambda r: r[2])
    for i, (want, r) in enumerate(zip(brute(texts, length), got, strict=True)):
        assert r == (*want, i)


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(8)
    one, two = made(rng, 500), made(rng, 900)
    texts, ids = [one, one, two, None, None], [1, 1, None, None, None]
    want = brute(texts, substrings.LENGTH)
    assert sorted(map(repr, held(spark, texts, ids))) == sorted(repr((*w, i)) for w, i in zip(want, ids, strict=True))
    assert held(spark, []) == []


def test_query(spark, tmp_path):
    from graphloom.llm.queries import QUERIES

    texts = texts_of(random.Random(3), 400, 12)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op12_substrings"](spark, str(tmp_path)).collect()}
    for i, (t, (runs, kept)) in enumerate(zip(texts, brute(texts, 400), strict=True)):
        n = len((t or "").encode())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
