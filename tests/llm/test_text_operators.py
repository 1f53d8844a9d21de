"""Each text operator against a brute-force version or an exact round trip, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, htmltext, jaccard, linedup, pii, quality, sharding, toolcalls, toxicity
from graphloom.llm import queries as Q
from graphloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, w int, lines string, id string, c string, part string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, "x", "x", "x", "x") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like internals."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 60) for _ in range(300))
    return table(spark, [None, "", "   \n\t", "one", "one", long, long, "a" * 50000, "é😀 x"], [None, 1, 2, 3, 3, 4, 4, 5, 6])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", "xx#", "..", "Ab*", "zz\n"]) for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, "", "a b c a b c a b c"]
    got = {r["doc_id"]: r for r in quality.quality(table(spark, texts)).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_is_one_projection(spark, odd, empty):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality.quality(odd).count() == odd.count()
    assert quality.quality(empty).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(2)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5 ", "+1 (202) 555-0100", "+49", "é", " ", "\n", "-", ".", "_", "007.08.9.1", "a@b.c_d@e.f.g", "12", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    got = {r["doc_id"]: r["s"] for r in pii.pii(table(spark, texts)).select("doc_id", F.expr(pii.joined("base_spans")).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == base_spans(text or ""), text


def test_pii_added_kinds_and_context(spark, odd, empty):
    texts = ["my IBAN: DE89 3704 0044 0532 0130 00.", "DE88 3704 0044 0532 0130 00", "call 202-555-0100 now", "number 202-555-0100 now", "+1 202-555-0100"]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.pii(table(spark, texts)).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["local_phone"], 3: [], 4: ["phone"]}
    secret = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    texts = [
        f'token = "{secret}" after', f"{secret} is the key", f"sha {secret}", f"the commit with token {secret}", f"tokenise {secret}", "password = " + "abcdef" * 5, "key=" + "1234567890" * 3, "token " + secret[:19],
        "hotel 202-555-0100", "tel 202-555-0100", "202-555-0100 (fax)", "202-555-0100 faxed", "x" * 50 + "tel" + " " * 40 + "202-555-0100", "tel" + " " * 41 + "202-555-0100", "ISBN or iban DE89 3704 0044 0532 0130 00", "isbn DE89 3704 0044 0532 0130 00",
    ]
    got = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"]] for r in pii.pii(table(spark, texts)).collect()}
    phone = [("local_phone", "202-555-0100")]
    kinds = [[("secret", secret)]] * 2 + [[], [], [], [], [], []] + [[], phone, phone, [], [], [], [("iban", "DE89 3704 0044 0532 0130 00")], []]
    assert got == dict(enumerate(kinds))
    plan = pii.pii(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert pii.pii(odd).count() == odd.count() and pii.pii(empty).count() == 0
    many = table(spark, ["1" * 200000, "a@" * 20000, "1." * 50000, "x" * 300000 + "@a.b"])
    assert [len(r["spans"]) for r in pii.pii(many).orderBy("doc_id").collect()] == [0, 0, 12500, 1]


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    passages = ["\n".join(words(rng, n) for n in sizes) for sizes in ((60,), (30, 30), (10, 10, 10, 10, 15), (51,), (20, 20))]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randint(1, 70)) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(parts) + rng.choice(["", "\n", "\n\n"]))
    seen, expected = {}, {}
    for k, text in enumerate(texts):
        lines = text.split("\n")
        full = [(i, x, len(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a in range(len(full)):
            n, b = 0, a
            while b < len(full) and n < linedup.WORDS:
                n += full[b][2]
                b += 1
            if n >= linedup.WORDS:
                content = tuple(x for _, x, _ in full[a:b])
                if content in seen:
                    gone |= set(range(full[a][0], full[b - 1][0] + 1))
                else:
                    seen[content] = (k, a)
        expected[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(table(spark, texts), extend=False).collect()}
    assert got == expected


def test_line_dedup_extends_to_the_last_line(spark):
    """Against all equal runs of 50 words or more, by pairs of places."""
    rng = random.Random(4)
    passages = ["\n".join(words(rng, n) for n in sizes) for sizes in ((30, 30, 15), (100, 20), (60,), (20, 20), (7,), (10, 10, 10, 10, 15, 3))]
    texts = [f"{words(rng, 9)}\n{p}\n{words(rng, 9)}" for p in passages[:2] for _ in range(2)]
    for _ in range(40):
        texts.append("\n".join(rng.choice(passages) if rng.random() < 0.7 else words(rng, rng.randint(1, 70)) for _ in range(rng.randint(1, 5))))
    full = [[(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for t in texts]
    gone = [set() for _ in texts]
    for d, own in enumerate(full):
        for e in range(d + 1):
            for a in range(len(own)):
                for b in range(a if e == d else len(full[e])):
                    n = 0
                    while a + n < len(own) and b + n < len(full[e]) and own[a + n][1] == full[e][b + n][1]:
                        n += 1
                    if sum(x[2] for x in own[a : a + n]) >= linedup.WORDS:
                        gone[d] |= {x[0] for x in own[a : a + n]}
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)}
    assert len(expected[1].split("\n")) == len(expected[3].split("\n")) == 2
    assert {r["doc_id"]: r["text"] for r in linedup.dedup_lines(table(spark, texts)).collect()} == expected


def test_line_dedup_odd_rows(spark, odd, empty):
    out = linedup.dedup_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    assert sum(r["text"] is None for r in rows) == 1
    twins = [r["text"] for r in rows if r["doc_id"] == 4]
    assert twins[0] == twins[1] and len(twins[0]) > 1000  # rows with the same id and text are one document
    assert linedup.dedup_lines(empty).count() == 0
    clash = odd.withColumnsRenamed({"t": "__text_hash", "w": "__gone", "lines": "__GONE_ID"})
    again = linedup.dedup_lines(clash)
    assert again.columns == clash.columns and sorted(map(str, (r["text"] for r in again.collect()))) == sorted(map(str, (r["text"] for r in rows)))
    assert {r["__gone"] for r in again.collect()} == {1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bpe_round_trip_and_library(spark, odd, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "abé中 '''  \n\t 　stmdrvlle019½!?#́\U0001f600\x00\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["'re", "x'r", "''s", " 's", "a" * 4000, "ab " * 900 + "<|endoftext|>"]
    docs = table(spark, texts).unionByName(odd)
    encoded = bpe.encode(docs, path)
    got = bpe.decode(encoded, path).join(encoded.select("doc_id", "ids", "offsets").distinct(), ["doc_id", "ids"]).collect()
    assert len({(r["doc_id"], bytes(r["ids"])) for r in got}) >= len(texts)
    for r in got[:3000]:
        text = bytes(r["decoded"]).decode()
        ids = bpe.as_array(bytes(r["ids"]))
        assert ids == library.encode_ordinary(text) and r["n_tokens"] == len(ids)
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_bpe_scan_crosses_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    import numpy as np

    text = "it's we'll  don't 've\n\n x'r ''s 12ab!? " * 5
    small = bpe.token_starts(text, np.zeros(0, int)).tolist()
    monkeypatch.setattr(bpe, "CHUNK", 1 << 20)
    assert small == bpe.token_starts(text, np.zeros(0, int)).tolist()


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks to a family
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = words(rng, rng.randint(60, 120)).split()
        for _ in range(rng.randint(1, 18)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(" ".join(copy))
    texts += [words(rng, 80) for _ in range(10)] + ["short text", "short text", "short  text", None, "", ""]
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(table(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    classes = {}
    for k, t in enumerate(texts):
        classes.setdefault(tuple(WORD.findall(t or "")) or ("none", k), []).append(k)
    links = {v[0]: set() for v in classes.values()}
    reps = sorted(links)
    for i in reps:
        for j in reps:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    root = {}
    for r in reps:
        stack = [] if r in root else [r]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = r
                stack += links[x]
    assert any(len(x) > 3 for x in links.values())
    for v in classes.values():
        for k in v:
            r = got[k]
            assert (r["text_class"], r["class_id"], r["n_links"], r["n_copies"]) == (v[0], root[v[0]], len(links[v[0]]), len(v) - 1)
    kept = sorted(r["doc_id"] for r in jaccard.dedup(table(spark, texts)).select("doc_id").collect())
    assert kept == sorted(set(root.values()))


def test_jaccard_odd_rows(spark, odd, empty):
    out = jaccard.dedup(odd)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert jaccard.jaccard_classes(empty).count() == 0
    assert jaccard.bands_for(0.8, 0.9999, 4) == 18


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for n in sorted({x for p in pairs for x in p}):
        stack = [] if n in root else [n]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = n
                stack += [b if a == x else a for a, b in pairs if x in (a, b)]
    assert got == root


def test_decontamination(spark, odd, empty):
    rng = random.Random(8)
    items = [words(rng, rng.randint(15, 50)) for _ in range(12)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(98, None), (99, "too short")], "item_id long, text string")

    def edited(text, share):
        return " ".join(words(rng, 1) if rng.random() < share else w for w in text.split())

    texts, expected = [], set()
    for k in range(12):
        for share in (0.0, 0.15):
            copy = edited(items[k], share).upper() + "!"
            if share and sum(a == b for a, b in zip(copy.lower().rstrip("!").split(), items[k].split())) < 0.75 * len(items[k].split()):
                continue
            expected.add((len(texts), k))
            texts.append(f"{words(rng, 40)} {copy} {words(rng, 40)}")
        texts.append(words(rng, 90) + " " + " ".join(items[k].split()[:5]))
    got = decontam.contamination(table(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    for r in got:
        if texts[r["doc_id"]].lower().find(items[r["item_id"]]) >= 0:
            assert r["score"] == 1.0 and (r["first_word"], r["end_word"]) == (40, 40 + len(items[r["item_id"]].split()))
    clean = decontam.decontaminate(table(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontam.decontaminate(odd, bench).count() == odd.count()
    assert decontam.contamination(empty, bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_finds_what_unseeded_alignment_finds(spark):
    """Edits at every 4th or 5th word, and words put in between, also where the originals lie elsewhere."""
    import numpy as np

    from graphloom.llm import shingles

    rng = random.Random(12)
    pool = words(rng, 150).split()
    items = [" ".join(rng.choice(pool) if rng.random() < 0.6 else words(rng, 1) for _ in range(rng.randint(3, 45))) for _ in range(14)]
    texts, sure = [], set()
    for k, item in enumerate(items):
        w = item.split()
        changed = [" ".join(words(rng, 1) if i % step == step - 1 else x for i, x in enumerate(w)) for step in (3, 4, 5)]
        spread = [" ".join(x + " " + words(rng, 1) if i % step == 0 else x for i, x in enumerate(w)) for step in (1, 2, 3)]
        for n, copy in enumerate([*changed, *spread]):
            if len(w) >= 20 and n in (1, 2, 4, 5):
                sure.add((len(texts), k))
            texts.append(" ".join([*rng.choices(pool, k=rng.randint(0, 60)), copy, *rng.choices(pool, k=30)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def hashed(text):
        return shingles.word_hashes([text], fold=True)[0]

    for extra in ([], items):  # without and with the originals among the documents
        found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(table(spark, texts + extra), bench).collect()}
        pairs = [(d, k) for d in range(len(texts + extra)) for k in range(len(items))]
        best, _, _ = decontam.align([hashed(items[k]) for _, k in pairs], [hashed((texts + extra)[d]) for d, _ in pairs])
        size = np.array([len(items[k].split()) for _, k in pairs])
        expected = {p: b / (2 * n) for p, b, n in zip(pairs, best.tolist(), size.tolist()) if b >= max(n, 2 * decontam.N)}
        assert sure <= set(expected)
        assert found == pytest.approx(expected)


def test_alignment_against_plain_smith_waterman():
    import numpy as np

    rng = random.Random(9)
    items = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 12))], np.uint64) for _ in range(60)]
    windows = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 20))], np.uint64) for _ in range(60)]
    best, _, _ = decontam.align(items, windows)
    for item, window, score in zip(items, windows, best):
        h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
        top = 0
        for i in range(1, len(item) + 1):
            for j in range(1, len(window) + 1):
                s = 2 if item[i - 1] == window[j - 1] else -1
                h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
                top = max(top, h[i][j])
        assert score == top


def test_resharding_laws(spark, odd, empty):
    rng = random.Random(10)
    texts = ["x" * rng.choice([1, 5, 50, 500, 3000]) for _ in range(700)] + [None]
    docs = table(spark, texts)
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 9)
    for law in ("rows", "bytes"):
        rows = sharding.reshard(docs, old, 12, law).collect()
        assert len(rows) == len(texts)
        by = {s: [r for r in rows if r["shard"] == s] for s in range(12)}
        for own in by.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        else:
            sizes = [sum(r["size"] for r in own) for own in by.values()]
            assert max(sizes) <= 1.25 * sum(sizes) / 12
    assert sharding.reshard(odd, F.lit(None).cast("int"), 4).count() == odd.count()
    assert sharding.reshard(empty, F.lit(0), 4).count() == 0


def test_flow_moves_the_fewest_bytes():
    from itertools import product

    rng = random.Random(11)
    for _ in range(25):
        blocks = [sharding.Block(rng.randrange(4), k, rng.randint(1, 4), 0) for k in range(4)]
        for b in blocks:
            b.size = b.rows * rng.randint(1, 9)
        moved = sharding.solve(blocks, 3, "rows")
        unit = [(b.old, b.size // b.rows) for b in blocks for _ in range(b.rows)]
        n = len(unit)
        best = min(
            sum(size for (old, size), new in zip(unit, choice) if old != new)
            for choice in product(range(3), repeat=n)
            if max(map(choice.count, range(3))) - min(map(choice.count, range(3))) <= 1
        ) if n <= 9 else None
        counts = Counter()
        for b in blocks:
            assert sum(k for _, _, k in b.runs) == b.rows
            for _, shard, k in b.runs:
                counts[shard] += k
        assert max(counts.values()) - min(counts[s] for s in range(3)) <= 1
        assert best is None or moved == best


def test_resharding_moves_the_smallest_rows(spark, monkeypatch):
    """Exactly the fewest bytes that single rows allow, with a hot block of several parts and groups of parts."""
    monkeypatch.setattr(sharding, "PART_ROWS", 50)
    monkeypatch.setattr(sharding, "GROUP_PARTS", 4)
    rng = random.Random(21)
    texts = ["same text"] * 900 + ["y" * rng.randint(0, 4000) for _ in range(1500)] + ["z" * 1000] * 300
    docs = table(spark, texts, [0] * 300 + list(range(300, len(texts))))
    old = F.when(F.length("text") == 9, 0).when(F.length("text") == 1000, 1).otherwise(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(5)))
    rows = sharding.reshard(docs, old, 7).collect()
    shards = [[r for r in rows if r["shard"] == s] for s in range(7)]
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards)
    target = len(texts) // 7
    assert all(len(own) in (target, target + 1) for own in shards)
    least = 0
    for shard in range(5):
        own = sorted(r["size"] for r in rows if r["old"] == shard)
        gone = sum(r["old"] == shard != r["shard"] for r in rows)
        assert gone >= len(own) - target - 1
        least += sum(own[:gone])
    assert sum(r["size"] for r in rows if r["old"] != r["shard"]) == least


def test_rewrite_writes_affected_shards_only(spark, tmp_path):
    docs = table(spark, ["a" * k for k in range(40)]).withColumn("Shard", F.lit("own"))
    placed = sharding.reshard(docs, F.col("doc_id") % 2, 3)
    path = str(tmp_path / "new")
    assert sharding.rewrite(docs, placed, path) == [0, 1, 2]
    back = spark.read.parquet(path)
    assert back.columns == [*docs.columns, "shard_"]
    assert back.count() == 40 and back.groupBy("shard_").count().where("count NOT IN (13, 14)").count() == 0
    with pytest.raises(Exception, match="already exists"):
        sharding.rewrite(docs, placed, path)


def toxic_tables(spark, n=600):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(n):
        text, toxic = words(rng, 40).split(), k % 6 == 0
        if toxic and k % 12 == 0:
            text[5:5] = ["you", "pathetic", "Idiot,", "worthless", "scum"]
        elif toxic:
            text[7:7] = ["zorbla" + words(rng, 1), "zorbla" + words(rng, 1)]
        rows.append(" ".join(text))
        if k % 3 < 2 or not toxic:
            labels.append((k, int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_shouting_counts_every_letter():
    import numpy as np

    voters = toxicity.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    none = np.zeros(0, np.int64)
    texts = ["Abcd" * 512, "aBCD" * 512, "AB c", "A b c"]  # of the first two, every fourth character is another case
    assert [v >> (toxicity.VOTERS - 1) for v in voters.votes(texts, none, none).tolist()] == [0, 1, 0, 0]


def test_toxicity_held_out(spark, odd, empty):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    held = [r for r in scored if r["held"]]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored)
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.where("score >= 0.5").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    plain = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(table(spark, ["what a pathetic worthless idiot", "a nice day"]), plain).orderBy("doc_id").collect()[0]["score"] >= 0.5


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = toxic_tables(spark, 120)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, x)).orderBy("doc_id").select("score").collect() for x in (labels, flipped))
    assert a == b


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>A &amp; B</h1><p>First <b>part</b> of\n the text.<p>Second&nbsp;one, 1 &lt; 2.<script>var p="</p>";</script>
<div class="ad-banner">Buy now</div><!-- <p>no</p> --><p>Third<br>line.</p><p>Ok.</p><aside>Related</aside><form><label>Mail</label><input name=x><button>Send</button></form>
<section class="comments"><article class="comment"><p>A reader wrote a long comment here, with many words, and more of them.</p></article></section></article></main>
<div id="sidebar"><p>A long sidebar paragraph that looks like text, with commas, and a full stop.</p></div><footer>&copy; Site</footer></body></html>"""


def test_html_main_text(spark, empty):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, None, "<p>cut <b", "x"), (5, "u", "plain text only", "x"), (None, "u", "<nav>menu</nav>", "x")], "page_id long, url string, html string, text string")
    model = htmltext.fit(pages)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, model).collect()}
    assert got[1] == "A & B\n\nFirst part of the text.\n\nSecond one, 1 < 2.\n\nThird line.\n\nOk."
    assert got[2] == got[3] == "" and got[None] == ""
    assert htmltext.extract(pages.limit(0), htmltext.fit(pages.limit(0))).count() == 0


def test_html_keeps_formulas_and_stand_ins(spark):
    """What an article shows in place of scripts and objects is text; very long pages and repeated rows are whole."""
    rng = random.Random(30)
    long = "".join(f"<p>{words(rng, 30)}.</p>" for _ in range(3000))
    page = """<html><body><nav><a href=/>Home</a></nav><article><h1>Sums</h1><p>We know that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds here.</p>
<noscript><p>A chart shows that the values rise, year by year.</p></noscript><p>See <object data=x>the picture of it</object> and <canvas>the curve</canvas>.</p>
<select><option>One</option></select><template><p>Hidden.</p></template></article><noscript>Please enable scripts.</noscript></body></html>"""
    rows = [(1, page), (2, f"<html><body><article>{long}</article></body></html>"), (1, page)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = htmltext.extract(pages, htmltext.fit(pages)).collect()
    texts = [r["text"] for r in got if r["page_id"] == 1]
    assert texts == ["Sums\n\nWe know that a=b holds here.\n\nA chart shows that the values rise, year by year.\n\nSee the picture of it and the curve."] * 2
    assert next(r["text"] for r in got if r["page_id"] == 2) == long.replace("<p>", "").replace("</p>", "\n\n").strip()


def test_minimum_cut_is_minimal():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(13)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        gain = rng.normal(0, 1, n)
        ties = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label, gain=gain, ties=ties):
            return sum(-g for g, x in zip(gain, label) if x) + sum(w for a, b, w in ties if label[a] != label[b])

        best = min(cost(label) for label in product([False, True], repeat=n))
        assert cost(htmltext.minimum_cut(gain, ties).tolist()) == pytest.approx(best)


def test_tool_calls(spark):
    tools = '<tools>[{"name":"add","parameters":{"type":"object","properties":{"a":{"type":"integer","minimum":0},"b":{}},"required":["a"],"additionalProperties":false}}]</tools>'
    call = '<tool_call>{{"id":"{}","name":"{}","arguments":{}}}</tool_call>'
    rows = [
        (1, 0, "system", tools), (1, 1, "tool", '{"tool_call_id":"c2","content":{"b":1,"a":2.0}}'),
        (1, 3, "assistant", "ok " + call.format("c2", "add", '{"b":1.5,"a":{"$ref":"c1"}}') + call.format("c1", "add", '{"a":1}')),
        (1, 4, "tool", '{"tool_call_id":"c1","content":"é"}'), (1, 5, "assistant", call.format("c1", "add", '{"a":1}')),
        (1, 6, "assistant", call.format("c3", "add", '{"a":-1,"z":0}')), (1, 7, "assistant", "<tool_call>{bad</tool_call>"),
        (1, 8, "tool", '{"tool_call_id":"zz","content":null}'), (1, 9, "tool", "not json"),
        (2, 0, "assistant", call.format("p", "other", "{}")), (None, None, None, None), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("mine"))
    got = toolcalls.link(messages).collect()
    status = Counter((r["conv_id"], r["turn"], r["call_id"], r["status"]) for r in got if r["status"] != "text")
    assert status == Counter([
        (1, 1, "c2", "linked"), (1, 3, "c2", "linked"), (1, 3, "c1", "linked"), (1, 4, "c1", "linked"), (1, 5, "c1", "duplicate"), (1, 6, "c3", "invalid"),
        (1, 7, None, "malformed"), (1, 8, "zz", "orphan"), (1, 9, None, "malformed"), (2, 0, "p", "unknown_tool"),
    ])
    at = {(r["part"], r["call_id"]): (r["order_turn"], r["order_depth"], r["turn"]) for r in got if r["status"] == "linked"}
    assert at["call", "c1"] < at["call", "c2"] < at["result", "c2"] and at["call", "c1"] < at["result", "c1"]
    json_of = {(r["part"], r["call_id"]): r["json"] for r in got}
    assert json_of["result", "c2"] == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c2"}'
    assert json_of["call", "c3"] == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"a":-1,"z":0},"name":"add"},"id":"c3","type":"function"}]}'
    assert sorted(next(r["problems"] for r in got if r["call_id"] == "c3")) == ["$.a: under minimum", "$.z: nothing is allowed"]
    assert sum(r["conv_id"] == 3 for r in got) == 2
    assert toolcalls.link(messages.limit(0)).count() == 0


def test_tool_calls_order_random_graphs(spark):
    """Places, depths and cycles against a search by depth, with needs of unknown calls, long chains and null turns."""
    rng = random.Random(31)
    calls = []
    for conv in range(30):
        n = rng.randint(1, 12)
        for k in range(n):
            needs = [f"c{rng.randrange(n + 2)}" for _ in range(rng.randint(0, 2))] if conv % 3 else ([f"c{k - 1}"] if k else [])
            calls.append((conv if conv else None, f"c{k}", None if rng.random() < 0.1 else rng.randrange(20), needs))
    known = {(c, r): (t, n) for c, r, t, n in calls}

    def place(conv, ref, path=()):
        if ref in path:
            return None
        turn, needs = known[conv, ref]
        behind = [place(conv, x, (*path, ref)) for x in needs if (conv, x) in known]
        if None in behind:
            return None
        turns = [t for t in [turn, *(t for t, _ in behind)] if t is not None]
        return max(turns, default=None), 1 + max((d for _, d in behind), default=-1)

    got = toolcalls._order(spark.createDataFrame(calls, "conv long, ref string, turn long, needs array<string>")).collect()
    assert len(got) == len(calls)
    for r in got:
        expected = place(r["conv"], r["ref"])
        assert (r["order_turn"], r["order_depth"], r["cyclic"]) == ((known[r["conv"], r["ref"]][0], 0, True) if expected is None else (*expected, False))


def test_schemas_good_and_bad():
    ok = toolcalls.well_formed
    assert ok(True) and ok({"type": ["string", "null"], "properties": {"a": {"minLength": 2}}, "description": 5})
    for bad in ({"pattern": "("}, {"type": "text"}, {"type": {"a": 1}}, {"minimum": "1"}, {"minItems": None}, {"enum": 4}, {"required": "a"}, {"$ref": "#/a"}, {"anyOf": []}, {"multipleOf": 0}, [1], None, {"items": {"not": 3}}):
        assert not ok(bad), bad
    cases = [
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]), ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, [1, 9], [4]), ({"allOf": [{"minimum": 3}, {"maximum": 5}]}, [4], [1, 9]),
        ({"not": {"type": "null"}}, [0], [None]), ({"exclusiveMinimum": 1, "exclusiveMaximum": 4}, [2], [1, 4]), ({"multipleOf": 0.1}, [0.3, 7], [0.35]), ({"uniqueItems": True}, [[1, 2]], [[1, 1.0]]),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, [{"x1": 3}], [{"x1": "3"}, {"y": 3}]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"type": "integer"}, [10**400, 2.0], [2.5, True]), ({"enum": [1, "a"]}, [1, 1.0], [True, "b"]), ({"const": {"a": 1}}, [{"a": 1.0}], [{"a": 2}]),
    ]
    for schema, good, wrong in cases:
        assert ok(schema)
        assert not any(toolcalls.problems(v, schema) for v in good), schema
        assert all(toolcalls.problems(v, schema) for v in wrong), schema
    assert toolcalls.judged("{}", '{"pattern": "("}') == (True, []) and toolcalls.judged("{}", None) == (False, [])
    deep = '{"items":' * 3000 + "true" + "}" * 3000
    assert toolcalls.judged("1", deep) == (True, [])


def test_tool_declarations_of_null_turns_come_first(spark):
    tools = '<tools>[{"name": "f", "parameters": %s}]</tools>'
    call = '<tool_call>{"id": "%s", "name": "f", "arguments": {"a": 1}, "depends_on": %s}</tool_call>'
    rows = [
        (1, None, "system", tools % '{"required": ["b"]}'), (1, 0, "system", tools % "true"), (1, 1, "assistant", call % ("x", '"yz"')), (1, 2, "assistant", call % ("yz", "null")), (1, 3, "assistant", call % ("w", "7")),
        (2, 0, "system", tools % '{"pattern": "("}'), (2, 1, "assistant", call % ("x", "[]")), (3, 0, "system", tools % '{"type": "a"}'), (3, 0, "system", tools % '{"maxProperties": 0}'), (3, 1, "assistant", call % ("x", "[]")),
    ]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("role = 'assistant'").collect()
    assert {(r["conv_id"], r["turn"], r["status"], r["order_turn"], r["order_depth"]) for r in got} == {(1, 1, "invalid", 2, 1), (1, 2, "invalid", 2, 0), (1, 3, "malformed", 3, 0), (2, 1, "bad_schema", 1, 0), (3, 1, "invalid", 1, 0)}


def test_registered_queries():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES)
    assert names == list(range(1, 11))
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def test_digests(spark, tmp_path):
    table(spark, ["hello world", None, "é"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.op5_byte_bpe(spark, str(tmp_path)).collect()}
    assert [got[k]["decoded_sha256"] for k in range(3)] == [hashlib.sha256(t.encode()).hexdigest() for t in ("hello world", "", "é")]
