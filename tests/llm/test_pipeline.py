"""The pipeline on a small corpus with planted cases, each stage against what it should do."""

import random

import numpy as np
import pytest

import corpus_pipeline
from fathom.llm import line_dedup, packing
from fathom.llm.storage import save
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    texts = ["\n".join(sentence() for _ in range(rng.randint(3, 8))) for _ in range(240)]
    labels = []
    for i in range(0, 240, 5):
        parts = texts[i].split(" ")
        for _ in range(3):
            parts[rng.randrange(len(parts))] = rng.choice(["stinker", "blockhead", "nitwit"])
        texts[i] = " ".join(parts)
    labels = [(i, int(i % 5 == 0)) for i in range(240)]
    passage = " ".join(rng.choice(words) for _ in range(20))
    texts[31] = "start of it. " + passage + ", and the end of this document"
    texts[32] = passage
    shared = sentence() + "\n" + sentence()
    texts[41], texts[42] = texts[41] + "\n" + shared, shared + "\n" + texts[42]
    texts.append(texts[51])  # an exact copy
    near = texts[61].replace("\n", " ").split(" ")
    near[-1] = "changed."
    texts[61] = texts[61].replace("\n", " ")
    texts.append(" ".join(near))
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    held = {"documents": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, planted), name)
        assert docs.columns == COLUMNS
        rows = docs.collect()
        held[name] = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(held[name]) and all(r["n_chars"] == len(r["text"]) for r in rows)
    start, calm, lines, unique, clean = held["documents"], *(held[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert set(calm) == {i for i in start if i >= 240 or i % 5} and all(calm[i] == start[i] for i in calm)
    assert 240 not in lines  # a copy: no word of it stays
    assert lines[41] == calm[41] and lines[42] == "\n".join(calm[42].split("\n")[2:])
    assert all(lines[i] == calm[i] for i in lines if i != 42)
    groups = brute.components(list(lines.items()), 5, 80, 100)
    assert set(unique) == {i for i in lines if groups[i][1] == i} and 241 not in unique and 61 in unique
    assert 32 not in clean and clean[31] == "start of it. , and the end of this document"
    assert all(clean[i] == unique[i] for i in clean if i != 31) and set(clean) == set(unique) - {32}


def test_run_packs_what_is_left(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, planted), name)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    encode = packing.Encoder(packing.tokenizer_path())
    got = corpus_pipeline.run(spark, planted).collect()
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(np.frombuffer(encode(t), dtype="<u4")) + 1 for i, t in left.items()}


def test_rows_that_repeat_and_nulls(spark, planted):
    rows = [(1, "a b c d e f g", "en", None, 13), (1, "a b c d e f g", "en", None, 13), (None, None, None, None, None), (2, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            df = save(stage(spark, df, planted), name)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = save(stage(spark, docs, planted), name)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect() if r["doc_id"] is not None) == [(False, 1), (False, 2)] and docs.count() == 3


def test_blocks_need_words():
    a, b = [1, 2, 3, 4], [9, 2, 3, 8]
    assert line_dedup.blocks(a, b, [5, 5, 5, 5], 10) == [1, 2] and line_dedup.blocks(a, b, [5, 4, 5, 5], 10) == []
