"""Findings of round 4: queries against their SQL and plain versions, on small tables with odd rows."""

import hashlib
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fathom.functions import text as X
from fathom.operators import chunking, knn, models, vector_blocks, vector_index
from fathom.plans import search
from fathom.sources.snapshots import Store
from tests.test_stored_index import committed, scan, stored


def against_sql(spark, folder, name, **tables):
    """The rows of a query, and those of its SQL, over tables that are written to folder."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_character_windows_of_empty_texts(spark, tmp_path):
    texts = [None, "", "a", " ", "ab\U0001f600" * 700]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got, want = against_sql(spark, tmp_path, "character_windows", documents=df)
    assert got == want and [r[0] for r in got] == [2, 3, 4]


def test_sentences_are_found_once_and_as_by_the_pattern(spark):
    rng = random.Random(4)
    texts = [None, "", ".", '."', 'a.."」 b', "a\n.\n", " . ", "x" * 900, *("".join(rng.choice('a. \n"」。！\U0001f600bcd') for _ in range(rng.randint(0, 30))) * rng.randint(1, 60) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    nothing = F.lit(None).cast("string")
    made = df.select("id", "text", X.enhance(F.col("text"), nothing, nothing, F.array().cast("array<string>"), nothing).alias("out"))
    for r in made.collect():
        t, points = r["text"] or "", None
        every = [s for s in (x.strip(" ") for x in re.findall(r'[^。！？.!?]*[。！？.!?]["」]?|[^。！？.!?]+$', t)) if s]
        if len(t) > 800 and every:
            chosen = [every[0], *([every[-1]] if len(every) > 1 else [])]
            longest = max(every, key=len)
            points = " ".join([*chosen, *([longest] if len(every) > 2 and longest not in chosen else [])])
        assert r["out"] == "\n".join(([f"[要点] {points}"] if points else []) + ([t] if r["text"] is not None else []))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") + plan.count("split(text") == 1


def test_postings_name_documents_by_place_and_shuffle_files_go(spark, tmp_path):
    """Ids stand once, in the table of documents, whatever their length; nothing that a write shuffled stays on disk."""
    rng = random.Random(6)
    texts = {hashlib.sha256(str(i).encode()).hexdigest(): " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(1, 60))) for i in range(600)}
    texts |= {hashlib.sha256(b"long").hexdigest(): "w1 w2 " * 70_000}
    rows = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id string, owner string, text string")
    files = lambda: {x for x in (spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in x}
    store, before = Store(spark, str(tmp_path)), files()
    committed(store, rows)
    # sums of a few rows may leave files, texts and postings may not
    left = lambda: sum(os.path.getsize(x) for x in files() - before if os.path.exists(x))
    deadline = time.time() + 20
    while left() > 10_000 and time.time() < deadline:
        time.sleep(0.5)
    assert left() <= 10_000
    # 301 blocks of 5 slots and their heads; an id of 64 bytes in each of the 18,000 postings is over a megabyte
    assert sum(p.stat().st_size for p in (tmp_path / "data/blocks").rglob("*.parquet")) < 700_000
    for query, k in (("w1 w7", 10), ("w2", 1), ("w5 w9 w100", 700), ("absent", 3)):
        assert stored(store, query, k) == scan(texts, query, k), query


def vectors(spark, n, seed=8, dim=6):
    """n vectors, some of them copies, and three without a score: null, with a null inside, of another length."""
    rng = np.random.default_rng(seed)
    made = [[float(x) for x in v] for v in rng.normal(size=(n, dim)).astype(np.float32)]
    for i in range(0, n, 7):
        made[i] = made[i // 50]
    made += [None, [1.0, None, *[0.0] * (dim - 2)], [1.0] * (dim - 1)]
    return list(enumerate(made)), spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<float>")


def row_by_row(df):
    return "zip_with" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [3, 1000])
def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch, k):
    listed, df = vectors(spark, 400 if k < 1000 else 60)
    monkeypatch.setattr(vector_blocks, "VECTORS", 64)
    monkeypatch.setattr(vector_blocks, "QUERIES", 5)
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    made = knn.knn_many(df, asked, k)
    want = []
    for q, y in listed:
        if q % 20 == 0 and y and None not in y:
            far = [(i, None if not x or None in x or len(x) != len(y) else 1 / (1 + float(np.cumsum((np.array(x) - y) ** 2)[-1]) ** 0.5)) for i, x in listed]
            far.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
            want += [(q, i, s, n) for n, (i, s) in enumerate(far[:k], 1)]
    got = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in made.collect() if listed[r["query_id"]][1] and None not in listed[r["query_id"]][1])
    assert sorted(got, key=lambda r: (r[0], r[3])) == want
    assert not row_by_row(made)


def test_all_pairs_meet_in_blocks(spark, monkeypatch):
    listed, df = vectors(spark, 300)
    monkeypatch.setattr(vector_blocks, "VECTORS", 16)
    made = knn.similar_pairs(df, 0.7)
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in listed if x and None not in x and len(x) == 6}
    want = {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.7}
    got = {(r["a"], r["b"]): r["similarity"] for r in made.collect()}
    assert got == pytest.approx(want) and made.count() == len(want) and not row_by_row(made)
    blocked = knn.similar_pairs(df.withColumn("part", F.col("vec_id") % 3), 0.7, block="part")
    assert {(r["a"], r["b"]) for r in blocked.collect()} == {p for p in want if p[0] % 3 == p[1] % 3}


def test_queries_meet_cells_in_blocks(spark, tmp_path):
    listed, df = vectors(spark, 900)
    rows = df.filter("vec_id < 900").select(F.format_string("%05d", "vec_id").alias("id"), F.format_string("%05d", "vec_id").alias("owner"), F.lit("m").alias("model"), "embedding")
    store = Store(spark, str(tmp_path))
    for new, gone in ((rows, None), (None, rows.filter("cast(id as int) % 9 = 0").select("owner"))):
        base = store.snapshot()
        parts, totals = vector_index.add_segment(store, base, new, gone)
        store.commit(base, parts, totals=totals)
    asked = df.filter("vec_id % 50 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    made = vector_index.search_many(store, store.snapshot(), asked, 4, "m")
    assert not row_by_row(made)
    got = sorted((r["query_id"], r["rank"], int(r["id"]), r["score"]) for r in made.collect())
    want = []
    for q in range(0, 900, 50):
        far = sorted((-1 / (1 + float(np.cumsum((np.array(x) - listed[q][1]) ** 2)[-1]) ** 0.5), i) for i, x in listed[:900] if i % 9)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(far[:4], 1)]
    assert got == want


def test_a_request_cuts_its_texts_once(spark, tmp_path):
    rng = random.Random(9)
    words = ["erenth", "ndor", "thing", *(f"w{i}" for i in range(50))]
    texts = ["\n\n".join(" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    made = __spark_entry__.queries()["search_request"](spark, str(tmp_path))
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    files = df.select(F.col("doc_id").cast("string").alias("file_id"), F.format_string("notes/%d.md", "doc_id").alias("path"), "source", "text")
    model = models.HashingEmbedder(64)
    request = search.Request("erenth ndor thing", vector=model(["erenth ndor thing"])[0], rerank=True, top_k=5)
    want = search.search(search.build_index(files, model=model), request)["results"].select("id", "path", F.round("score", 6).alias("score"), "rank")
    assert sorted(made.collect(), key=lambda r: r["rank"]) == sorted(want.collect(), key=lambda r: r["rank"]) and made.count() == 5


def test_tokens_are_counted_by_bytes():
    for t in ("", "abc XYZ 019 .,", "aé日本語Ω٣ß9", "\U0001f600䷿一鿿", "\n\t "):
        cjk = len(chunking.CJK.findall(t))
        letters, digits = sum(c.isascii() and c.isalpha() for c in t), sum(c.isascii() and c.isdigit() for c in t)
        assert chunking.count_tokens(t) == int(cjk / 1.5) + letters // 4 + digits // 3 + (len(t) - cjk - letters - digits) // 2
