"""Records, context layouts, stored and incremental indexes, against plain versions and round trips."""

import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as X, vectors as V
from fathom.operators import bm25, context, fusion, records
from fathom.plans import record_queries, search
from fathom.sources import files, tables
from fathom.streaming import changes


def one(spark, column, **values):
    names = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_pages_and_validation(spark):
    df = spark.range(10)
    assert [r[0] for r in records.page(df, 2, 3, F.desc("id")).collect()] == [6, 5, 4]
    assert [r[0] for r in records.page(df, 0, 3, "id").collect()] == [0, 1, 2] and records.page(df, 9, 3, "id").count() == 0
    ok = lambda p: one(spark, records.allowed_path(F.col("p"), ["C:\\Vault\\Notes", "/mnt/x/"]), p=p)
    assert ok("c:/vault/notes/a.md") and ok("C:\\VAULT\\NOTES") and ok("/mnt/x/y") and not ok("c:/vault/notes/../secret") and not ok("c:/vault/notesx/a") and not ok(None or "")
    span = lambda a, b: one(spark, records.allowed_range(F.col("a"), F.col("b"), 20), a=a, b=b)
    assert span(1, 20) and not span(1, 21) and not span(0, 5) and not span(5, 4)


def test_json_values(spark):
    assert one(spark, records.string_list(F.col("t")), t='["a", "b"]') == ["a", "b"] and one(spark, records.string_list(F.col("t")), t="no list") == []
    assert one(spark, records.string_map(F.col("t")), t='{"a": 1, "b": "x"}') == {"a": "1", "b": "x"} and one(spark, records.loose_double(F.col("t")), t="1.5") == 1.5
    assert one(spark, records.loose_double(F.col("t")), t="n/a") == 0.0


def test_budget_cuts_the_first_that_does_not_fit(spark):
    long = "one two three four five six. " * 60
    rows = [(1, "abcd " * 100), (2, long), (3, "short")]
    df = spark.createDataFrame(rows, "rank long, content string")
    tokens = {r["rank"]: r["n"] for r in df.select("rank", X.count_tokens(F.col("content")).alias("n")).collect()}
    got = {r["rank"]: r["content"] for r in context.budget_with_tail(df, tokens[1] + 150).collect()}
    assert set(got) == {1, 2} and got[1] == rows[0][1]
    sentence = one(spark, X.count_tokens(F.col("s")), s=" one two three four five six")
    assert got[2].count("。") == 1 + (150 - one(spark, X.count_tokens(F.col("s")), s="one two three four five six")) // sentence
    assert set(r["rank"] for r in context.budget_with_tail(df, tokens[1] + 90).collect()) == {1}
    assert context.budget_with_tail(df, 10**6).count() == 3 and context.budget_with_tail(df.limit(0), 10).count() == 0


def test_blocks_of_hits(spark):
    df = spark.sql("SELECT 'a/b.md' AS p, 'H1' AS h, array(named_struct('hit', false, 'content', 'before'), named_struct('hit', true, 'content', 'it')) AS x")
    got = df.select(context.hit_block(F.col("p"), F.col("h"), F.col("x")).alias("b"), context.hit_block(F.col("p"), F.lit(""), F.slice("x", 2, 1), F.lit(3), F.lit(7)).alias("s")).first()
    assert got["b"] == "📍 **来源**: a/b.md\n📑 **章节**: H1\n\n---\n\nbefore\n\n> it\n\n" and got["s"] == "📍 **来源**: a/b.md (L3-L7)\n\nit\n"


def test_wordpieces(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "run", "##ning", "##s", "the", ",", "中", "文"]
    ids = lambda t, **more: one(spark, X.wordpieces(F.col("t"), vocabulary, **more), t=t)
    assert ids("The running, runs 中文 zebra") == [2, 7, 4, 5, 8, 4, 6, 9, 10, 1, 3] and ids("") == [2, 3]
    assert ids("the the the the", most=4) == [2, 7, 7, 3] and ids("run" + "s" * 70) == [2, 1, 3]


def test_folded_letters():
    marked, bare = X.LATIN_MARKS
    assert len(marked) == len(bare) > 200 and all(unicodedata.normalize("NFD", m)[0] == b for m, b in zip(marked, bare, strict=True)) and "é" in marked


def test_vectors_that_do_not_match_are_an_error(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) AS a, array(0.0D, 0.0D) AS z, array(1.0D) AS b")
    assert df.select(V.checked_cosine(F.col("a"), F.col("a")).alias("x"), V.checked_cosine(F.col("a"), F.col("z")).alias("y")).first()[:] == (1.0, 0.0)
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.checked_cosine(F.col("a"), F.col("b"))).collect()


def test_files_that_are_gone_have_no_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.md", "b.txt", "c.bin"):
        (tmp_path / name).write_text(f"text of {name}")
        (tmp_path / "in" / name).write_text("below")
    got = {r["path"]: r["text"] for r in files.safe_texts(spark, [str(tmp_path / "a.md"), str(tmp_path / "gone.md")]).collect()}
    assert got == {str(tmp_path / "a.md"): "text of a.md", str(tmp_path / "gone.md"): None}
    assert files.safe_texts(spark, [str(tmp_path / "gone.md")]).first()["text"] is None
    assert files.scan(spark, [str(tmp_path), str(tmp_path / "in")]).count() == 4  # a root inside another one gives nothing twice
    listed = files.scan(spark, [str(tmp_path)])
    files.write_json(files.report(listed), str(tmp_path / "report"))
    assert {(r["extension"], r["n"]) for r in files.read_json(spark, str(tmp_path / "report"), "extension string, n long").collect()} == {(".md", 2), (".txt", 2)}


def test_record_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "m1", "x"), (2, "m2", "x"), (3, None, "y")], "id long, model string, kind string")
    files.append_records(df, str(tmp_path / "r"))
    files.append_records(df.filter("id = 1"), str(tmp_path / "r"))
    files.clear_records(spark, str(tmp_path / "r"), str(tmp_path / "s"), model="m1", kind="x")
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [2, 3]
    files.append_token_log(spark.createDataFrame([("t", "query", "m", 5)], "ts string, op string, model string, tokens long"), str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["t|query|m|5"]
    files.append_queries(spark.createDataFrame([("q",)], "query string"), str(tmp_path / "q"))
    assert len(spark.read.parquet(str(tmp_path / "q")).first()["query_hash"]) == 16


def test_stored_index_reads_the_terms_of_the_query(spark, tmp_path):
    rows = [(i, f"word{i % 7} common thing{i % 3} " * (1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    bm25.write_index(df, str(tmp_path / "ix"), "id", "text", buckets=8)
    for query in ("word3 thing1", "common", "absent word5 word5", "absent"):
        got = bm25.search_index(spark, str(tmp_path / "ix"), query, 5, buckets=8)
        expected = bm25.search(df, "id", "text", query, None).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(5)
        assert [(r["id"], pytest.approx(r["score"])) for r in expected.collect()] == [(r["id"], r["score"]) for r in got.collect()]
    plan = bm25.search_index(spark, str(tmp_path / "ix"), "word3", 5, buckets=8)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*term", plan)


def test_an_updated_index_equals_a_new_one(spark, tmp_path):
    texts = [(i, f"# Title {i}\n\nbody of {i}, see [[f{(i + 1) % 40}]]\n\n" + "more words here. " * (i % 5), "en", f"s{i % 2}") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    before, now = record_queries.stored_files(spark, str(tmp_path))
    index, after = search.update_index(search.build_index(before), before.drop("text"), now)
    fresh = search.build_index(now)
    state = lambda ix: {(r["path"], r["chunk_index"], r["content"], tuple(r["embedding"])) for r in ix.chunks.join(ix.vectors, "chunk_id").collect()}
    assert state(index) == state(fresh) and index.chunks.count() == fresh.chunks.count()
    assert {tuple(r) for r in index.edges.collect()} == {tuple(r) for r in fresh.edges.collect()}
    assert {r["path"]: r["hash"] for r in after.collect()} == {r["path"]: r["hash"] for r in now.collect()}
    gone, changed = search.changed_files(before.drop("text"), now)
    assert 0 < changed.count() < now.count() and search.changed_files(now.drop("text"), now, force=True)[1].count() == now.count()
    # files of a source that is not enabled stay as they were
    part, _ = search.update_index(search.build_index(before), before.drop("text"), now, enabled=["s0"])
    kept = {r["path"] for r in part.chunks.filter("source = 's1'").collect()}
    assert kept == {r["path"] for r in before.filter("source = 's1'").collect()}


def test_optimised_lists(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1.0 - i / 10, f"text {i}", f"a/{i}.md" if i % 2 else f"b/{i}.md", ["X"] if i < 4 else ["y"], t + dt.timedelta(days=i), "g") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, score double, content string, path string, tags array<string>, modified timestamp, g string")
    ids = lambda **more: [r["id"] for r in fusion.optimize(df, 3, "g", **more).orderBy("rank").collect()]
    assert ids(folder="a/") == [1, 3, 5] and ids(tags=["x"], start=t + dt.timedelta(days=1)) == [1, 2, 3] and ids(end=t) == [0]


def test_renames_cancel_changes(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(t(1), "a", "b"), (t(2), "b", "c"), (t(3), "x", "a")], "ts timestamp, old_path string, path string")
    assert {(r["path"], r["old_path"]) for r in changes.renames(events).collect()} == {("c", "b"), ("a", "x")}
    seen = spark.createDataFrame([("a", t(0)), ("a", t(4)), ("c", t(5)), ("x", t(3))], "path string, ts timestamp")
    assert {(r["path"], r["ts"]) for r in changes.without_renamed(seen, events).collect()} == {("a", t(4)), ("c", t(5))}
    assert {r["path"] for r in changes.idle(seen, F.lit(t(5)), 1000).collect()} == {"a", "x"}


def test_small_tables_are_counted_before_they_are_broadcast(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(tables.if_small(spark.range(5), 5)) and not hinted(tables.if_small(spark.range(6), 5))


def test_keyword_recall_may_exceed_one(spark):
    assert one(spark, records.keyword_recall(F.col("a"), F.lit(3), F.col("b")), a=5, b=4) == pytest.approx(5 / 3) and one(spark, records.keyword_recall(F.col("a"), F.lit(3), F.col("b")), a=0, b=0) == 0.0
