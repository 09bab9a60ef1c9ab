"""Exact values and properties of the retrieval operators."""

import datetime as dt
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from fathom.functions import hashing as H, text as X, vectors as V
from fathom.operators import bm25, chunking, evaluation, fusion, graph, knn, stats, sync
from fathom.sources import files as files_source
from fathom.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text_rows(spark, *texts):
    return spark.createDataFrame([(f"doc{i}", t) for i, t in enumerate(texts, 1)], "id string, content string")


def found(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "texts,query,expected",
    [
        (["apple apple apple apple apple", "apple apple", "apple"], "apple", ["doc1", "doc2", "doc3"]),
        (["The quick brown fox jumps", "cats and dogs"], "fox", ["doc1"]),
        (["这是一段中文测试文本", "另一个文档"], "测试", ["doc1"]),
        (["The cat sits on the mat"], "the", []),
        (["The cat sits on the mat"], "cat", ["doc1"]),
        (["Hello 世界"], "世界", ["doc1"]),
        (["test document"], " \t", []),
        (["test document"], "test test test", ["doc1"]),
        (["编程", "语言", "编程语言", "其他"], "编程 语言", ["doc3", "doc1", "doc2"]),
    ],
)
def test_bm25_classic(spark, texts, query, expected):
    got = found(bm25.search(text_rows(spark, *texts), "id", "content", query))
    assert set(got) == set(expected) and got[:1] == expected[:1]


def test_bm25_full_text_values(spark):
    docs = spark.createDataFrame([("d1", "apple apple banana"), ("d2", "apple cherry"), ("d3", "banana date fig grape"), ("d4", "kiwi"), ("d5", "lemon mango")], "id string, content string")
    score = lambda q, **o: {r["id"]: r["score"] for r in bm25.search(docs, "id", "content", q, None, "fts", **o).collect()}
    assert score("apple banana") == pytest.approx({"d1": 0.6348645031, "d2": 0.3084328836, "d3": 0.2177173296})
    assert score("apple banana", k1=9.0) == pytest.approx({"d1": 0.6348645031, "d2": 0.3084328836, "d3": 0.2177173296})
    assert score("apple banana", b=0.2) == pytest.approx({"d1": 0.2533504757, "d2": 0.1184382273, "d3": 0.0740238921})
    assert score("apple apple") == pytest.approx({"d1": 0.7592194057, "d2": 0.6168657671})


def test_bm25_full_text_equals_sqlite(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "café", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, content, tokenize='unicode61 remove_diacritics 1')")
    con.executemany("insert into t values (?, ?)", [(f"doc{i}", t) for i, t in enumerate(texts, 1)])
    expected = {i: abs(s) for i, s in con.execute("select id, bm25(t, 1.5, 0.75) from t where t match '\"alpha\" OR \"cafe\"'")}
    got = {r["id"]: r["score"] for r in bm25.search(text_rows(spark, *texts), "id", "content", "alpha café", None, "fts").collect()}
    assert got == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("text,n", [("", 0), ("Hello world", 2), ("你好世界", 2), ("Hello 你好 world 世界", 5), ("Hello, world!", 3), ("short text", 2), ("a", 0), ("very long text with many words", 8)])
def test_count_tokens(spark, text, n):
    assert one(spark, X.count_tokens(F.lit(text))) == n == chunking.count_tokens(text)


def test_text_functions(spark):
    assert one(spark, X.expand_query(F.lit("编程 的 x"))) == "编程 程序设计 写代码 的 x"
    assert one(spark, X.analyze_intent(F.lit("为什么 bug"))) == "Definition" and one(spark, X.analyze_intent(F.lit("如何做"))) == "HowTo"
    assert one(spark, X.sentences(F.lit('One. "Two!" 三。tail'))) == ["One.", '"Two!"', "三。", "tail"]
    assert one(spark, X.key_sentences(F.lit("a. bb. longest of all. c."))) == ["a.", "c.", "longest of all."]
    assert one(spark, X.folder_keywords(F.lit("docs/my-notes/api_v2/x"))) == "my notes api v2"
    assert one(spark, X.truncate_by_sentences(F.lit("abcdefgh. abcdefgh. abcdefgh."), 4)) == "abcdefgh。 abcdefgh。"
    link = one(spark, X.parse_link(F.lit("![[a/b.md#L3-L9|shown]]")))
    assert (link["file"], link["start_line"], link["end_line"], link["shown"], link["heading"]) == ("a/b.md", 3, 9, "shown", None)
    assert one(spark, X.parse_link(F.lit("[[n#^blk]]")))["block"] == "blk" and one(spark, X.parse_link(F.lit("[[n#Head]]")))["heading"] == "Head"
    assert one(spark, X.to_wsl(F.lit("D:\\a\\b"))) == "/mnt/d/a/b" and one(spark, X.from_wsl(F.lit("/mnt/d/a/b"))) == "D:\\a\\b"
    assert one(spark, H.short_hash(F.lit(""))) == "" and len(one(spark, H.sampled_fingerprint(F.lit(b"x" * 9000)))) == 64


def test_vector_functions(spark):
    v = lambda *x: V.literal(x)
    assert one(spark, V.cosine(v(1, 0), v(0, 1))) == 0 and one(spark, V.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, V.cosine(v(1), v(1, 1))) == 0
    assert one(spark, V.l2_normalize(v(3, 4))) == [0.6, 0.8] and one(spark, V.l2_normalize(v(0, 0))) == [0, 0]
    assert one(spark, V.cosine_truncated(v(1, 0, 5), v(1, 0))) == 1 and one(spark, V.from_distance(F.lit(1.0))) == 0.5
    assert sum(one(spark, V.softmax(v(1, 2, 3)))) == pytest.approx(1)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 4.0, 1), (2, 2.0, 2)], "id long, score double, rank long")
    b = spark.createDataFrame([(2, 0.8, 1), (3, 0.4, 2)], "id long, score double, rank long")
    got = {r["id"]: r["score"] for r in fusion.weighted(a, b).collect()}
    assert got == pytest.approx({1: 0.35, 2: 0.35 * 0.5 + 0.65, 3: 0.65 * 0.5})
    got = {r["id"]: r["score"] for r in fusion.rrf(a, b).collect()}
    assert got == pytest.approx({1: 0.5 / 60, 2: 1 / 61 + 1 / 60, 3: 0.5 / 61})
    assert fusion.FusionOptions(bm25_weight=0.9).validated() == fusion.FusionOptions()
    empty = a.limit(0)
    assert {r["id"]: r["score"] for r in fusion.weighted(empty, b).collect()} == pytest.approx({2: 0.65, 3: 0.325})


def test_mmr_prefers_other_texts(spark):
    rows = [(1, 1, 1.0, "the same text"), (1, 2, 0.99, "the same text"), (1, 3, 0.9, "quite other words")]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, content string")
    assert found(fusion.mmr(df, 2)) == [1, 3]


def test_filters(spark):
    df = spark.createDataFrame([("Notes/a.md",), ("notesx/b.md",), ("notes",), ("x/notes/c.md",)], "path string")
    assert [r[0] for r in df.filter(fusion.folder_filter(F.col("path"), "notes")).collect()] == ["Notes/a.md", "notes"]
    assert [r[0] for r in df.filter(fusion.folder_filter(F.col("path"), "notes", False)).collect()] == ["Notes/a.md"]
    src = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "source string")
    assert fusion.sources_filter(src, ["a"]).count() == 3 and fusion.sources_filter(src, ["a", "b"], ["b"], False).count() == 1


def test_similar_pairs_finds_all(spark):
    rng = random.Random(1)
    unit = lambda x: [c / math.sqrt(sum(d * d for d in x)) for c in x]
    base = [unit([rng.gauss(0, 1) for _ in range(8)]) for _ in range(20)]
    vs = [unit([c + rng.gauss(0, 0.15) for c in rng.choice(base)]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    expected = {(i, j) for i in range(120) for j in range(i + 1, 120) if dot(vs[i], vs[j]) >= 0.9}
    got = [(r["a"], r["b"]) for r in knn.similar_pairs(df, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("See [[Projects/MyNote]]", [("Projects/MyNote.md", "wikilink", 1)]),
        ("See [[Projects/MyNote|My Display Name]]", [("Projects/MyNote.md", "wikilink", 1)]),
        ("See [[Projects/MyNote#Section 1]]", [("Projects/MyNote.md", "wikilink", 1)]),
        ("![[images/diagram.png]]", [("images/diagram.png", "embed", 1)]),
        ("This is a #project note", [("project", "tag", 1)]),
        ("See [[Note1]] and [[Note2]]\n#tag1", [("Note1.md", "wikilink", 1), ("Note2.md", "wikilink", 1), ("tag1", "tag", 2)]),
        ("```\n[[ignored]]\n```", []),
        ("x\n[[A]]\ny\n[[B]]", [("A.md", "wikilink", 2), ("B.md", "wikilink", 4)]),
        ("[[Note.md]]", [("Note.md", "wikilink", 1)]),
    ],
)
def test_links(spark, text, expected):
    df = spark.createDataFrame([("f", text)], "id string, text string")
    got = graph.extract_links(df, "id", "text").collect()
    assert sorted((r["target"], r["type"], r["line"]) for r in got) == sorted(expected)


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "Foo Bar", "document"), ("b", "Baz Qux", "document"), ("c", "C", "document")], "id string, title string, type string")
    edges = spark.createDataFrame([("a", "b", "wikilink", 1), ("b", "c", "wikilink", 2)], "from_id string, to_id string, type string, line_number int")
    root = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.neighbors(nodes, edges, root, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.neighbors(nodes, edges, root, 1).count() == 2 and [r["id"] for r in graph.search_nodes(nodes, "foo").collect()] == ["a"]
    left = graph.delete_nodes(nodes, edges, root)
    assert left[0].count() == 2 and left[1].count() == 1
    s = graph.stats(nodes, edges).first()
    assert (s["n_nodes"], s["n_edges"]) == (3, 2)
    new = graph.replace_file_graph(nodes, edges, nodes.filter("id = 'a'").withColumn("title", F.lit("New")), edges.filter("from_id = 'a'").withColumn("to_id", F.lit("c")), root)
    assert {r["id"]: r["title"] for r in new[0].collect()}["a"] == "New" and {(r["from_id"], r["to_id"]) for r in new[1].collect()} == {("b", "c"), ("a", "c")}


def test_title_search(spark):
    nodes = spark.createDataFrame([("n/apple.md", "Apple", "document"), ("n/pie.md#Apple crust", "Apple crust", "heading"), ("n/x.md", "pineapple", "document")], "id string, title string, type string")
    chunks = spark.createDataFrame([("c1", "n/apple.md", 0, "", "x"), ("c2", "n/pie.md", 0, "", "x"), ("c3", "n/pie.md", 1, "Apple crust/Pie", "y"), ("c4", "n/x.md", 0, "", "z"), ("c5", "n/x.md", 1, "", "an apple")], "chunk_id string, path string, chunk_index int, heading string, content string")
    got = [(r["chunk_id"], r["score"]) for r in graph.title_search(nodes, chunks, "apple").collect()]
    assert got == [("c1", 1.0), ("c5", 0.95), ("c3", 0.92)]


def test_chunks_cover_all_lines():
    text = "# Main\nintro\n## Sub\n" + "\n\n".join("sentence number %d is here. " % i * 6 for i in range(30)) + "\n### Detail\nend"
    got = chunking.chunk_text(text, 128, 20)
    assert got[0]["heading"] == "Main" and got[-1]["heading"] == "Detail/Sub/Main" and chunking.chunk_text("") == []
    covered = {n for c in got for n in range(c["start_line"], c["end_line"] + 1)}
    lines = text.split("\n")
    assert all(n in covered for n, line in enumerate(lines, 1) if line.strip())
    assert [c["chunk_index"] for c in got] == list(range(len(got)))


def test_evaluation_values(spark):
    def ranked(expected, order, scores=None):
        return spark.createDataFrame([(1, i, r, float(expected[i]), float((scores or [0] * 9)[r - 1])) for r, i in enumerate(order, 1)], "query_id long, id long, rank int, expected double, score double")

    value = lambda df, c: df.first()[c]
    assert value(evaluation.ndcg(ranked([1, 0.5, 0], [0, 1, 2])), "ndcg") == 1 and value(evaluation.ndcg(ranked([1, 0.5, 0], [2, 1, 0])), "ndcg") < 0.8
    assert value(evaluation.mrr_top(ranked([0.3, 1, 0.5], [1, 2, 0])), "mrr") == 1 and value(evaluation.mrr_top(ranked([0.3, 0.5, 1], [0, 1, 2])), "mrr") == pytest.approx(1 / 3)
    assert value(evaluation.average_precision(ranked([0.9, 0.2, 0.7, 0.3, 0.8], range(5))), "ap") == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert value(evaluation.errors(ranked([0.9, 0.5, 0.1], range(3), [0.85, 0.6, 0.2])), "mae") == pytest.approx(0.08333, abs=1e-4)
    assert value(evaluation.mrr_top(ranked([0, 0, 0], range(3))), "mrr") == 0 and evaluation.ndcg(ranked([1], [])).count() == 0


def test_query_summary(spark):
    t = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([(t, 100.0, 5), (t, 200.0, 10), (t, 150.0, 7), (t - dt.timedelta(days=30), 9999.0, 1)], "ts timestamp, duration_ms double, results int")
    r = stats.query_summary(log, F.lit(t)).first()
    assert (r["n"], r["avg_ms"], r["max_ms"], r["min_ms"], round(r["avg_results"], 2)) == (3, 150, 200, 100, 7.33)
    assert stats.query_summary(log.limit(0), F.lit(t)).first()["avg_ms"] == 0


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert {(r["k"], r["v"]) for r in sync.upsert(old, new, ["k"], "o").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    disk = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "path string, hash string")
    assert {r["path"]: r["change"] for r in sync.classify_changes(stored, disk).collect()} == {"a": "Unchanged", "b": "Modified", "c": "Deleted", "d": "New"}
    assert [(r["old"], r["new"]) for r in sync.detect_moves(stored, disk).collect()] == [("c", "d")]


def test_scan(spark, tmp_path):
    for name, text in {"a.md": "# A", "b.TXT": "b", "c.bin": "c", "sub/d.md": "d", ".git/e.md": "e", "draft.md": "f"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files_source.scan(spark, [str(tmp_path)], exclude_dirs=["/.git/"], exclude_files=["draft*"])
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in files_source.texts(got).collect()} == {"a.md": "# A", "b.TXT": "b", "d.md": "d"}
    assert {r["extension"]: r["n"] for r in files_source.report(got).collect()} == {".md": 2, ".txt": 1}


def test_streams_equal_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(milliseconds=m), "mod") for m in (0, 200, 600, 2000)] + [("b", t, "del"), ("z", t + dt.timedelta(hours=1), "mod")]
    df = spark.createDataFrame(rows, "path string, ts timestamp, change string")
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["path"], r["n"]) for r in changes.debounce(df).collect()}
    assert batch == {("a", 3), ("a", 1), ("b", 1), ("z", 1)}
    stream = changes.debounce(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    # the last session waits for its watermark
    assert {(r["path"], r["n"]) for r in spark.table("debounced").collect()} == batch - {("z", 1)}


def test_stream_of_upserts(spark, tmp_path):
    for v in ("old", "new"):
        spark.createDataFrame([("k1", v), (f"only-{v}", v)], "path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.apply_changes(source, str(tmp_path / "out"), ["path"], str(tmp_path / "c2")).awaitTermination(120)
    got = {r["path"]: r["text"] for r in changes.current(spark, str(tmp_path / "out"), 1).collect()}
    assert set(got) == {"k1", "only-old", "only-new"} and got["only-new"] == "new"


def test_bounded_histogram_stream(spark, tmp_path):
    spark.createDataFrame([("m", float(i)) for i in range(1, 101)], "metric string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("metric string, value double").parquet(str(tmp_path / "in"))
    query = changes.bounded_histogram(source, n=50).writeStream.format("memory").queryName("histogram").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    r = spark.table("histogram").collect()[-1]
    assert (r["n"], r["p50"], r["p95"], r["p99"]) == (50, 75.0, 98.0, 100.0)


def test_search_and_context_reach_all_documents(spark, tmp_path):
    from fathom.plans import catalog

    texts = {i: f"plain line {i}\nother {i} words\nthird {i}" for i in range(230)}
    texts[227] = "start of it\nerenth ndor thing here\nafter it\nmore\nlast " + "far " * 200
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert run("search_request")[0]["path"] == "notes/227.md"
    lines = {i: t.split("\n") for i, t in texts.items()}
    around = {(f"{i}#{k}", f"{i}#{j}", j - k) for i, x in lines.items() for k in range(len(x)) for j in range(max(0, k - 1), min(len(x), k + 2))}
    for name in ("context_window", "context_by_position"):
        assert sorted(map(tuple, run(name))) == sorted(around)
    assert [tuple(r) for r in run("drill_down_searched")] == [("227#1", "\n\n---\n\n".join(lines[227][:4]))]
    assert [r["context"] for r in run("expand_context_searched")] == ["### part 0\nstart of it\n\n**[HIT]** erenth ndor thing here\n\nafter it"]
    got = run("build_context_searched")
    assert [(r["context"], r["n"]) for r in got] == [("### s\n\n**en**\n\nerenth ndor thing here\n\n[[a/s.md]]", 1)]


def test_whole_texts_count(spark, tmp_path):
    from fathom.operators import models
    from fathom.plans import catalog

    same = "abcd efg " * 20
    long = "First of it is important. " * 40 + "The last words."
    texts = {1: same + "xyzzy", 2: same + "plugh " * 30, 3: long, 4: "word " * 8000, 5: ""}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r[0]: r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}

    def jaccard(a, b):
        left, right = ([x[i : i + 2] for i in range(len(x) - 1)] for x in ("".join(a.split()), "".join(b.split())))
        common = sum(min(left.count(g), right.count(g)) for g in set(left))
        return round(common / (len(left) + len(right) - common), 6) if left and right else 0.0

    assert {i: r["similarity"] for i, r in run("bigram_similarity").items()} == {i: pytest.approx(jaccard(texts[i], texts[i + 1]), abs=1e-6) for i in range(1, 5)}
    made = run("enhanced")[3]["text"]
    assert made.endswith(long) and "[要点]" in made
    assert all(r["e0"] is not None for r in run("embed").values())
    bound = models.embed(text_rows(spark, "a b", "c" * 50), "content", most_chars=40).orderBy("id").collect()
    assert bound[0]["embedding"] is not None and bound[1]["embedding"] is None


def test_filters_by_tags_and_dates_and_recommended_models(spark):
    from fathom.operators import models

    rows = spark.createDataFrame([(1, ["Red", None], dt.datetime(2024, 1, 1)), (2, ["blue"], dt.datetime(2024, 1, 5)), (3, None, None), (4, [], dt.datetime(2024, 1, 9))], "id int, tags array<string>, at timestamp")
    ids = lambda c: [r["id"] for r in rows.filter(c).orderBy("id").collect()]
    assert ids(fusion.tags_filter(F.col("tags"), ["RED", "x"])) == [1] and ids(fusion.tags_filter(F.col("tags"), [])) == [1, 2, 3, 4]
    assert ids(~fusion.tags_filter(F.col("tags"), ["red"])) == [2, 3, 4]
    assert ids(fusion.date_filter(F.col("at"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5))) == [1, 2] and ids(fusion.date_filter(F.col("at"), dt.datetime(2024, 1, 5))) == [2, 4]
    assert ids(fusion.date_filter(F.col("at"))) == [1, 2, 4]
    registry = spark.createDataFrame([("a", ["en"], True, 1.0), ("b", None, True, 3.0), ("c", ["en", "zh"], False, 2.0), ("d", ["en"], True, None)], "name string, languages array<string>, is_gpu_supported boolean, benchmark_score double")
    names = lambda *a: [r["name"] for r in models.recommended(registry, *a).collect()]
    assert names() == ["b", "a", "d"] and names("en", False) == ["c", "a", "d"]
