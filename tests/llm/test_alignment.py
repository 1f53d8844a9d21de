"""Cross-tokenizer alignment against the public libraries and plain loops over token ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import alignment

FILES = (public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


@pytest.fixture(scope="module")
def both():
    with open(FILES[0], "rb") as a, open(FILES[1], "rb") as b:
        return alignment.Tokenizers(a.read(), b.read(), FILES[2])


def brute(libraries, texts):
    """Per text: counts and groups; over all texts the counts of linked pairs. By ranges of bytes."""
    a, b = libraries
    back = alignment.byte_alphabet()
    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append(None)
            continue
        ranges = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, own = 0, []
            for i, p in zip(ids, parts, strict=True):
                own.append((i, at, at + len(p)))
                at += len(p)
            ranges.append(own)
        links = [(i, j) for i, s, e in ranges[0] for j, t, f in ranges[1] if s < f and t < e]
        common = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        start, groups = 0, []
        for cut in common:
            groups.append("|".join(",".join(str(i) for i, s, e in own if start <= s and e <= cut) for own in ranges))
            start = cut
        docs.append((len(ids_a), len(ids_b), groups, links))
    total = Counter(x for d in docs if d for x in d[3])
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, "", ""))
        else:
            g = ";".join(d[2])
            rows.append((d[0], d[1], len(d[2]), len(d[3]), sum(total[x] == best[x[1]] for x in d[3]), sum(total[x] for x in d[3]), hashlib.sha256(g.encode()).hexdigest(), g))
    return rows


def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab Ωé漢 \n\t'sx1#🙂") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*made, None, "", " ", "  \n", "a▁b", "<|endoftext|> <s> <0x41> <unk>", "it's \r\n  y　z", "one", "one", "one two " * 300, "aaaa" * 500, "\x00\x1c\u0085", "don't  stop\n\n\nnow "]


def test_every_character_is_cut_as_the_library_cuts_it(libraries, both):
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in range(at, min(at + 256, 0x110000)) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 256)]
    texts = [t for t in texts if t]
    want = libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    for t, w in zip(texts, want, strict=True):
        assert both.a.encode_ordinary(" " + t) == w.ids


def test_statistics_and_groups(spark, libraries, monkeypatch):
    texts = odd_texts()
    want = brute(libraries, texts)
    rows = [(i % 50 if i else None, t, "x", 1, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, id int, pair string").repartition(3)
    got = alignment.link_statistics(df, *FILES).collect()
    as_bag = lambda found: Counter(map(repr, found))
    ids = [r[0] for r in rows]
    assert as_bag((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == as_bag((i, *w[:7]) for i, w in zip(ids, want, strict=True))
    aligned = alignment.align(df, *FILES).collect()
    assert as_bag((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) for r in aligned) == as_bag((i, *w[:4], w[7]) for i, w in zip(ids, want, strict=True))
    none = alignment.link_statistics(df.limit(0), *FILES)
    assert none.count() == 0 and none.columns == got[0].__fields__ and alignment.align(df.limit(0), *FILES).count() == 0


def test_many_chunks_and_rows(spark, libraries, monkeypatch):
    """Corpus-wide counts meet over chunks of a few rows each."""
    monkeypatch.setattr(alignment, "CHUNK", 300)
    monkeypatch.setattr(alignment, "BATCH", 100)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "γάμμα", "delta's", "e\n"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    table = alignment._table(df, alignment._files(spark, *FILES), "doc_id", "text")
    assert table.select("chunk").distinct().count() > 10
    got = {r.doc_id: r for r in alignment.link_statistics(df, *FILES).collect()}
    for i, w in enumerate(brute(libraries, texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w[:7]


def test_files_that_are_not_ranks():
    with open(FILES[0], "rb") as f:
        said = alignment.json.loads(f.read())
    said["model"]["merges"] = said["model"]["merges"][::-1]
    with open(FILES[1], "rb") as f, pytest.raises(ValueError, match="ranks"):
        alignment.Tokenizers(alignment.json.dumps(said).encode(), f.read(), FILES[2])
