"""The pipeline's stages on odd rows, on empty tables, and its decisions on planted cases."""

import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """``labels``, ``benchmark`` and ``documents`` with each kind of planted case, nulls, repeats and clashing names."""
    rng = random.Random(40)
    path = str(tmp_path_factory.mktemp("tables"))
    item = words(rng, 40)
    passage = "\n".join(words(rng, 30) for _ in range(3))
    near = words(rng, 200).split()
    texts = {k: words(rng, 120) for k in range(40)}
    texts |= {k: words(rng, 60) + " you pathetic worthless idiot scum " + words(rng, 20) for k in range(40, 60)}  # toxic
    texts |= {60: f"{words(rng, 70)}\n{passage}\n{words(rng, 10)}", 61: f"{words(rng, 70)}\n{passage}\n{words(rng, 10)}"}  # a repeated passage
    texts |= {62: " ".join(near), 63: " ".join([*near[:100], "other", *near[101:]]), 64: " ".join(near)}  # copies
    texts |= {65: f"{words(rng, 50)} {item} {words(rng, 50)}"}  # a leak
    rows = [(k, t, "x", None, len(t), "own") for k, t in texts.items()] + [(None, None, None, None, None, None), (66, "", "x", "y", 0, "own"), (67, None, "x", "y", 0, "own"), (0, texts[0], "x", None, 1, "own")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, __gone string"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int(40 <= k < 60)) for k in range(60)] + [(None, None, None), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_decide_on_planted_cases(spark, folder):
    import corpus_pipeline
    from graphloom.llm.common import read, written

    docs = read(spark, folder, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        assert name == "byte_bpe" or docs.columns == columns
        kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    assert not ids["toxicity"] & set(range(40, 60)) and ids["toxicity"] >= {*range(40), *range(60, 68), None}
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    lines = {r["doc_id"]: (r["text"] or "").count("\n") for r in kept["line_dedup"]}
    assert (lines[60], lines[61]) == (4, 1)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["line_dedup"])
    assert next(r["text"] for r in kept["line_dedup"] if r["doc_id"] == 64) == ""  # one line, all of it a copy; the row stays
    assert ids["ngram_jaccard"] & {62, 63, 64} == {62, 64} and ids["ngram_jaccard"] >= {*range(40), 60, 61, 65, 66, 67, None}
    assert sum(r["doc_id"] == 0 for r in kept["ngram_jaccard"]) == 1
    assert ids["decontamination"] == ids["ngram_jaccard"] - {65}
    assert ids["byte_bpe"] == ids["decontamination"]
    assert all((r["n_tokens"] == 0) == (r["doc_id"] in (64, 66, 67, None)) for r in kept["byte_bpe"])


def test_stages_on_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline
    from graphloom.llm.common import read, written

    for name in ("documents", "labels", "benchmark"):
        read(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # documents without any labels or benchmark items: the listed words decide, nothing leaks
    docs = read(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), f"test-{name}")
    left = {r["doc_id"] for r in docs.collect()}
    assert left >= {*range(40), 60, 61, 62, 65, 66, 67, None} and not left & set(range(40, 60))
