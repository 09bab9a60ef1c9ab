"""The stored index: commits, segments, early-ending search, and upkeep, against scans and rebuilds."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import keyword_index, models, sync
from fathom.plans import search, stored_index
from fathom.sources.snapshots import Conflict, Store
from fathom.streaming import changes

WORDS = [f"word{i}" for i in range(40)]
SMALL = models.HashingEmbedder(16)


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return {f"{i:05d}": " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 8, 20, 60, 200]))) for i in range(n)}


def rows(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id string, owner string, text string")


def committed(store, new=None, gone=None):
    base = store.snapshot()
    parts, totals = keyword_index.add_segment(store, base, new, gone)
    return store.commit(base, parts, totals=totals)


def scan(texts, query, k, k1=1.5, b=0.75):
    """The k best of all texts, one after another."""
    split = {i: t.split() for i, t in texts.items()}
    n, mean, scores = len(split), sum(map(len, split.values())) / len(split), dict.fromkeys(split, 0.0)
    for term in set(query.split()):
        df = sum(term in w for w in split.values())
        for i, w in split.items():
            if tf := w.count(term):
                scores[i] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    best = sorted(((i, round(x, 9)) for i, x in scores.items() if x), key=lambda r: (-r[1], r[0]))[:k]
    return [(i, pytest.approx(x, abs=2e-9)) for i, x in best]


def stored(store, query, k, version=None):
    return [(r["id"], r["score"]) for r in keyword_index.search(store, store.snapshot(version), query, k).orderBy("rank").collect()]


QUERIES = ["word0", "word3 word17", "word39", "word0 word1 word2 word30", "absent", "absent word5 word5", ""]


def test_early_ending_search_equals_a_scan(tmp_path):
    texts = corpus()
    store = Store(spark, str(tmp_path))
    committed(store, rows(spark, texts))
    for query, k in zip(QUERIES, (1, 10, 10, 5, 10, 3, 10), strict=True):
        assert stored(store, query, k) == scan(texts, query, k), query
    assert stored(store, "word35", 2000) == scan(texts, "word35", 2000)


def test_a_search_scores_few_slots(spark, tmp_path):
    """Documents of very different lengths, a term in all of them: the slots of long ones are never read."""
    rng = random.Random(3)
    texts = {f"{i:05d}": "common " + " ".join(rng.choices(WORDS, k=3 + i // 10)) for i in range(4000)}
    store = Store(spark, str(tmp_path))
    committed(store, rows(spark, texts))
    asked = keyword_index.Search(store, store.snapshot(), "common", 5)
    assert asked.bounds().count() >= 25 and asked.reached().count() <= 6
    assert stored(store, "common", 5) == scan(texts, "common", 5)
    shown = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan, heads = (df._jdf.queryExecution().toString() for df in (asked.top(), asked.bounds()))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", shown)
    assert re.search(r"PushedFilters: [^\n]*(In|EqualTo)\(slot", plan) and re.search(r"PushedFilters: [^\n]*(In|EqualTo)\(term", plan) and re.search(r"PartitionFilters: [^\n]*bucket", plan)
    # bounds are read without what the blocks hold
    assert "ReadSchema" in heads and not re.search(r"ReadSchema: [^\n]*held", heads)


def test_many_slots_are_joined_instead_of_pushed_down(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "PUSHED", 1)
    texts = corpus(500, 2)
    store = Store(spark, str(tmp_path))
    committed(store, rows(spark, texts))
    assert stored(store, "word1 word2", 10) == scan(texts, "word1 word2", 10)


def test_upserts_and_deletes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    state, store, versions = {}, Store(spark, str(tmp_path)), {}
    for step in range(3):
        new = {f"{rng.randrange(400):05d}": t for t in corpus(150, 10 + step).values()}
        gone = rng.sample(sorted(state), min(len(state), 40)) + ["never there"]
        snapshot = committed(store, rows(spark, new), spark.createDataFrame([(g,) for g in gone], "owner string"))
        state = {i: t for i, t in state.items() if i not in gone} | new
        versions[snapshot.version] = dict(state)
        assert snapshot.totals == {"n": len(state), "len": sum(len(t.split()) for t in state.values())}
    committed(store, None, spark.createDataFrame([(i,) for i in sorted(state)[:30]], "owner string"))
    state = {i: t for i, t in state.items() if i not in sorted(state)[:30]}
    replace, _ = keyword_index.merge(store, store.snapshot())
    counted = {t: sum(t in set(x.split()) for x in state.values()) for t in WORDS}
    for step in ("segments", "merged"):
        held = store.table(store.snapshot(), "terms", keyword_index.TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        assert {r["term"]: r["df"] for r in held.collect()} == {t: n for t, n in counted.items() if n}
        for query in QUERIES[1:4:2]:
            assert stored(store, query, 10) == scan(state, query, 10)
        if step == "segments":
            store.commit(store.snapshot(), {}, replace)
    assert len(store.snapshot().parts["blocks"]) == 1 and not store.snapshot().parts["dead"]
    # readers of older versions see what these held
    for version in (1, 2):
        assert stored(store, "word0 word9", 10, version) == scan(versions[version], "word0 word9", 10)
    assert store.vacuum(keep=1) > 0 and stored(store, "word0", 10) == scan(state, "word0", 10)
    with pytest.raises(ValueError):
        store.snapshot(1)


def test_nulls_in_the_keyword_index(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    committed(store, spark.createDataFrame([("a", "f", None), ("b", "f", ""), ("c", "g", "word1 x")], "id string, owner string, text string"))
    assert store.snapshot().totals["n"] == 3 and [i for i, _ in stored(store, "word1", 5)] == ["c"]
    with pytest.raises(Exception, match="id is null"):
        committed(store, spark.createDataFrame([(None, "f", "x")], "id string, owner string, text string"))
    assert store.snapshot().version == 1


def test_of_two_writers_one_has_a_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    base = store.snapshot()
    path = store.write(spark.range(3), "numbers", 1)
    assert store.commit(base, {"numbers": [path]}).version == 1
    with pytest.raises(Conflict):
        store.commit(base, {"numbers": [store.write(spark.range(9), "numbers", 1)]})
    assert store.table(store.snapshot(), "numbers", "id long").count() == 3
    assert store.vacuum() == 1 and store.table(store.snapshot(), "numbers", "id long").count() == 3


def notes(n, changed=(), without=()):
    body = lambda i: f"# Note {i}\n\nsome words about thing{i % 5}, see [[n{(i + 1) % n}]] and [[later]]\n\n## Part {i}\n\n" + "more of it here. " * (i % 4) + (f"\n\nadded text {i}" if i in changed else "")
    return [(i, f"d{i % 3}/n{i}.md", f"s{i % 2}", body(i)) for i in range(n) if i not in without]


def note_rows(spark, listed):
    df = spark.createDataFrame(listed, "file_id long, path string, source string, text string")
    return df.withColumn("hash", F.sha2("text", 256))


def state(index):
    chunks = {(r["path"], r["chunk_index"], r["content"], r["heading"], tuple(r["embedding"])) for r in index.chunks.join(index.vectors, "chunk_id").collect()}
    return chunks, {tuple(r) for r in index.nodes.select("id", "title", "type").collect()}, {tuple(r) for r in index.edges.select("from_id", "to_id", "type", "line_number").collect()}


def test_a_synchronised_store_equals_a_new_index(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, now = notes(12), [*notes(12, changed=(2, 7), without=(4,)), (40, "d0/later.md", "s0", "# Later\n\nwhat links waited for")]
    stored_index.synchronise(store, note_rows(spark, first), model=SMALL)
    stored_index.synchronise(store, note_rows(spark, now), model=SMALL)
    fresh = search.build_index(note_rows(spark, now), model=SMALL)
    opened = stored_index.open_index(store)
    assert state(opened) == state(fresh)
    # only what changed was cut and embedded
    last = store.rows(store.snapshot().parts["chunks"][-1:], "chunks", stored_index.CHUNKS)
    assert {r["path"] for r in last.select("path").collect()} == {"d2/n2.md", "d1/n7.md", "d0/later.md"}
    for request in (search.Request("thing3 words added", vector=[0.1] * 16, max_tokens=500), search.Request("later", vector=[0.1] * 16, graph_depth=1)):
        one, two = ([(r["path"], r["chunk_index"], round(r["score"], 6)) for r in search.search(ix, request)["results"].orderBy("rank").collect()] for ix in (opened, fresh))
        assert one == two and one
    # files of a source that is not enabled stay as they were
    stored_index.synchronise(store, note_rows(spark, notes(3)), enabled=["s0"], model=SMALL)
    kept = {r["path"] for r in stored_index.files(store, store.snapshot()).collect()}
    assert kept == {p for _, p, s, _ in now if s == "s1"} | {p for _, p, s, _ in notes(3) if s == "s0"}
    before = state(stored_index.open_index(store))
    stored_index.compact(store)
    assert state(stored_index.open_index(store)) == before and all(len(x) <= 1 for x in store.snapshot().parts.values())


def test_vectors_of_a_model_go_and_come_back(spark, tmp_path):
    store, files = Store(spark, str(tmp_path)), note_rows(spark, notes(6))
    stored_index.synchronise(store, files, model=SMALL)
    before = state(stored_index.open_index(store))[0]
    after, went = stored_index.drop_model(store, SMALL.name)
    assert went == len(before) and after.totals["vectors"] == 0
    index = stored_index.open_index(store)
    assert index.vectors.count() == 0 and index.chunks.count() == len(before) and index.nearest([0.1] * 16, 3).count() == 0
    assert stored_index.open_index(store, store.snapshot(1)).vectors.count() == len(before)
    assert stored_index.drop_model(store, "unknown")[1] == 0
    stored_index.synchronise(store, files, force=True, model=SMALL)
    assert state(stored_index.open_index(store))[0] == before and store.snapshot().totals["vectors"] == len(before)


def test_a_batch_that_fails_between_two_tables_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    stored_index.ingest(store, note_rows(spark, notes(5)), writer="w", batch=0, model=SMALL)
    before = state(stored_index.open_index(store))
    change = note_rows(spark, notes(5, changed=(1, 3)))
    whole = keyword_index.add_segment
    monkeypatch.setattr(keyword_index, "add_segment", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stored_index.ingest(store, change, spark.createDataFrame([(2,)], "file_id long"), writer="w", batch=1, model=SMALL)
    assert store.snapshot().version == 1 and state(stored_index.open_index(store)) == before
    monkeypatch.setattr(keyword_index, "add_segment", whole)
    for _ in range(2):  # tried again, and once more after its commit
        after = stored_index.ingest(store, change, spark.createDataFrame([(9,)], "file_id long"), writer="w", batch=1, model=SMALL)
        assert after.version == 2
    assert state(stored_index.open_index(store)) == state(search.build_index(change, model=SMALL))
    assert state(stored_index.open_index(store, store.snapshot(1))) == before
    assert store.vacuum(keep=2) > 0 and state(stored_index.open_index(store, store.snapshot(1))) == before


def test_a_stream_of_changes_keeps_the_index(spark, tmp_path):
    schema = "file_id long, path string, source string, text string, hash string, deleted boolean, ts int"
    put = lambda listed: spark.createDataFrame(listed, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    row = lambda i, text, ts, deleted=False: (i, f"n{i}.md", "s", text, text, deleted, ts)
    put([row(1, "one", 1), row(2, "two", 1), row(1, "one again", 3), row(1, "one between", 2)])
    put([row(2, "", 5, True), row(3, "three", 4)])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        stored_index.follow(source, store, str(tmp_path / "checkpoint"), model=SMALL).awaitTermination(300)
    assert store.snapshot().version == 2 and store.snapshot().applied == {"stream": 1}
    held = {r["path"]: r["content"] for r in stored_index.open_index(store).chunks.collect()}
    assert held == {"n1.md": "one again", "n3.md": "three"}


@pytest.mark.parametrize("turned", [False, True])
def test_the_newest_row_of_a_key_stays_whatever_the_order(spark, tmp_path, turned):
    schema = "path string, text string, ts int, v string, bucket string, row string"
    batches = [[("k1", "new", 5, "a", "b", "r"), ("k1", "old", 1, "x", "y", "z")], [("k1", "late", 2, "l", "l", "l"), ("k2", "two", 1, "a", "b", None)]]
    for rows_of in batches:
        spark.createDataFrame(rows_of[::-1] if turned else rows_of, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.apply_changes(source, str(tmp_path / "out"), ["path"], str(tmp_path / "c"), buckets=4, order="ts").awaitTermination(200)
    got = changes.current(spark, str(tmp_path / "out"), 1)
    assert got.columns == ["path", "text", "ts", "v", "bucket", "row"]
    assert {tuple(r) for r in got.collect()} == {("k1", "new", 5, "a", "b", "r"), ("k2", "two", 1, "a", "b", None)}


def test_upsert_without_an_order_refuses_repeats(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="several new rows"):
        sync.upsert(old, new, ["k"]).collect()
    assert {tuple(r) for r in sync.upsert(old, new.limit(1), ["k"]).collect()} == {(1, "x")}
