"""Requests with limits, the ways to merge a hit's neighbours, and statistics with times."""

import datetime as dt

import pytest

from fathom.operators import context, knn, models
from fathom.sources import files


def test_embedding_requests(spark):
    rows = [("ok", ["a b", "", "c"]), ("none", None), ("empty", []), ("many", ["x"] * 257), ("long", ["x", "y" * 32_001]), ("null", ["x", None]), ("most", ["z" * 32_000] * 256)]
    got = models.embed_requests(spark.createDataFrame(rows, "request_id string, input array<string>"), model=models.HashingEmbedder(4)).collect()
    errors = {r["request_id"]: r["error"] for r in got if r["error"]}
    assert errors == {
        "none": "input is required",
        "empty": "input array cannot be empty",
        "many": "input array cannot exceed 256 items",
        "long": "input[1] exceeds maximum length of 32000 characters",
        "null": "input must be an array of strings",
    }
    made = sorted((r["index"], [round(x, 6) for x in r["embedding"]]) for r in got if r["request_id"] == "ok")
    assert made == [(i, [round(float(x), 6) for x in v]) for i, v in enumerate(models.HashingEmbedder(4)(["a b", "", "c"]))]
    assert sum(r["request_id"] == "most" for r in got) == 256


def test_rerank_requests(spark):
    rows = [(1, "apple pie", ["pie", "apple pie now", "none", "apple"], 2), (2, "apple", ["x", "apple"], None), (3, None, ["x"], None), (4, "q", None, 1), (5, "the", ["the", "a"], None), (6, "q", ["x"] * 300, 1)]
    df = spark.createDataFrame(rows, "request_id int, query string, documents array<string>, top_n int")
    got = sorted((r["request_id"], r["rank"] or 0, r["index"], r["relevance_score"], r["error"]) for r in models.rerank_requests(df).collect())
    assert got == [
        (1, 1, 1, 1.0, None), (1, 2, 0, 0.5, None), (2, 1, 1, 1.0, None), (2, 2, 0, 0.0, None), (3, 0, None, None, "query is required and must be a string"), (4, 0, None, None, "documents is required"),
        (5, 1, 0, 0.0, None), (5, 2, 1, 0.0, None), (6, 0, None, None, "documents array cannot exceed 256 items"),
    ]
    by_length = models.rerank_requests(df.filter("request_id = 1"), lambda queries, texts: [float(len(t)) for t in texts])
    assert [r["index"] for r in by_length.orderBy("rank").collect()] == [1, 3]


def test_three_ways_to_merge(spark):
    chunks = spark.createDataFrame([(f"c{i}", "f", i, "H" if i < 2 else "J", f"text {i}") for i in range(4)], "chunk_id string, file_id string, chunk_index int, heading string, content string")
    hits = spark.createDataFrame([("c1",)], "hit_id string")
    merged = lambda **more: context.expand_context(hits, chunks, 1, **more).first()["context"]
    assert merged() == "### H\ntext 0\n\n**[HIT]** text 1\n\n### J\ntext 2"
    assert merged(merge="concatenate") == "text 0\n\ntext 1\n\ntext 2"
    assert merged(merge="separator") == "text 0\n\n---\n\ntext 1\n\n---\n\ntext 2" and merged(merge="separator", separator="|") == "text 0|text 1|text 2"
    with pytest.raises(ValueError):
        merged(merge="other")


def test_vector_statistics_with_times(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("a", [1.0, 2.0], t[0]), ("a", [1.0, 2.0], t[2]), ("b", [1.0], t[1])], "model string, embedding array<float>, at timestamp")
    assert sorted(map(tuple, knn.vector_stats(df, updated="at").collect())) == [("a", 2, 2, 16, t[2]), ("b", 1, 1, 4, t[1])]


def test_first_files_of_a_scan(spark):
    df = spark.createDataFrame([(f"p{i:03d}.md", i) for i in range(150)], "path string, length long").repartition(5)
    assert [r["path"] for r in files.listing(df).collect()] == [f"p{i:03d}.md" for i in range(100)]
