"""Periodic runs, token counts and the filter audit against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from fathom.llm import filter_audit, periodic_runs, query_filter_audit, query_periodic_runs, query_token_counts, token_counts, toxicity
from fathom.llm.batches import map_rows
from fathom.llm.storage import settings
from tests.llm.brute import words
from tests.llm.test_operators import HARD, rows

EXTRA = "'c' AS row, 'c' AS runs_, 'c' AS found, 'c' AS digest, 'c' AS n_tokens, 'c' AS counts, 'c' AS d, 'c' AS place, 'c' AS first, 'c' AS A, 'c' AS part, 'c' AS good"


def plain_runs(w, min_exp=4, least=6):
    """(start, length, period) of all runs, from each place and shift."""
    n, out = len(w), set()
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if (size := j - i + q) >= max(least, min_exp * q) and j > i:
                if not any(all(w[x] == w[x + k] for x in range(i, i + size - k)) for k in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def planted_words(i, text):
    w = words(text)
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]


def plain_digest(w):
    found = plain_runs(w)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic_corpus(seed=3, n=150):
    rng = random.Random(seed)
    texts = [*HARD, "a b " * 40 + "x " + "a b c " * 30, "w  w\n w w\tw w", "w w w w w", "a a a a a a b b b b b b", "ab " * 7 + "é " * 9]
    for _ in range(n):
        w = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            a, q = rng.randrange(len(w) + 1), rng.randint(1, 9)
            for i in range(a + q, min(len(w), a + q * rng.randint(3, 7))):
                w[i] = w[i - q]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(w))
    return list(enumerate(texts))


DIGEST = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("long,work", [(1 << 20, 1 << 24), (60, 300)])
def test_periodic_runs(spark, long, work):
    """Where they are read, and by ranges of shifts dealt to tasks."""
    docs = periodic_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = periodic_runs.runs(query_periodic_runs.planted(df), long=long, work=work)
    assert rows(query_periodic_runs.digest(found), *DIGEST) == {i: plain_digest(planted_words(i, t)) for i, t in docs}


@pytest.mark.parametrize("min_exp,least", [(4, 6), (2, 3), (3, 1)])
def test_scan_of_all_shifts(min_exp, least):
    rng = random.Random(min_exp)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        ids, found = np.array(w, dtype=np.int32), {}
        assert periodic_runs.scan(ids, 1, len(w), min_exp, least) == plain_runs(w, min_exp, least)
        for low, high in periodic_runs.ranges(len(w), min_exp, 600):
            for s, n, q in periodic_runs.scan(ids, low, high, min_exp, least):
                found[s, n] = min(q, found.get((s, n), q))
        assert sorted((s, n, q) for (s, n), q in found.items()) == plain_runs(w, min_exp, least)


def test_a_million_equal_words_and_a_long_plain_text(spark):
    n = 1_000_000
    plain = " ".join(str(i * i % 99_991) for i in range(300_000))
    df = spark.createDataFrame([(1, "w " * n), (2, "w " * n), (3, plain), (4, None)], "doc_id long, text string").repartition(4)
    found = periodic_runs.runs(df)
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in found.collect()}
    assert got[1] == got[2] == [(0, n, 1)] and got[4] == []
    assert all(q >= 1 and size >= 4 * q for _, size, q in got[3])
    assert rows(found.select("doc_id", periodic_runs.collapsed(found["text"], found["runs"]).alias("t")), "doc_id", "t")[1] == ("w",)


def test_periodic_runs_keep_rows_and_columns(spark):
    base = [(None, "a b a b a b a b"), (1, None), (1, None), (2, "w " * 50), (2, "w " * 50), (3, "")]
    df = spark.createDataFrame(base, "doc_id long, text string").selectExpr("*", *EXTRA.split(", "))
    for long in (1 << 20, 3):
        made = periodic_runs.runs(df, long=long)
        assert made.columns == [*df.columns, "runs"]
        assert sorted(map(str, ((r["doc_id"], len(r["runs"]), r["row"]) for r in made.collect()))) == sorted(map(str, [(None, 1, "c"), (1, 0, "c"), (1, 0, "c"), (2, 1, "c"), (2, 1, "c"), (3, 0, "c")]))
        assert periodic_runs.runs(df.limit(0), long=long).count() == 0


TOKENS = [*HARD, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "don't we'll 12345  \n\n x", " nbsp em \x1c sep", "日本語 text é", "²³ ½ 10²", "_under__score_ ...!!", "x" * 5000, "Zażółć gęślą \U0001f600\U0001f600", " lead", "trail "]


def plain_counts(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_each_library(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    df = spark.createDataFrame(list(enumerate(TOKENS)), "doc_id long, text string")
    got = rows(token_counts.count(df, token_counts.own_cache(spark), path), "doc_id", "n_bytes", "n_tokens")
    if name.endswith("model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(x or "")) for x in TOKENS]
    else:
        expected = plain_counts(TOKENS, path)
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(TOKENS, expected, strict=True))}


def test_counter_of_random_texts():
    rng = random.Random(8)
    signs = "ab Z'st1²9_é  \x1c\n\t .,!日\U0001f600ǅ<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    counter = token_counts.Counter(token_counts.tokenizer_path())
    assert [counter(t) for t in texts] == plain_counts(texts, token_counts.tokenizer_path())


@pytest.mark.parametrize("most", [0, 100_000])
def test_only_distinct_misses_are_encoded_and_appended(spark, monkeypatch, most):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", most)
    cache, path = token_counts.own_cache(spark), token_counts.tokenizer_path()
    of = token_counts.version(path)
    first = spark.createDataFrame([(i, f"text number {i % 5}") for i in range(50)], "doc_id long, text string")
    token_counts.count(first, cache).collect()
    assert cache.stored(of).count() == 5
    # a stored count is looked up, not made anew: this one is wrong on purpose
    marked = spark.createDataFrame([("text number 1",)], "t string").selectExpr("unhex(sha2(t, 256)) AS digest", "999L AS n_tokens")
    cache.append(marked, of)
    second = spark.createDataFrame([(1, "text number 1"), (2, "new one"), (3, "new one"), (None, None), (4, "")], "doc_id long, text string")
    got = rows(token_counts.count(second, cache), "doc_id", "n_tokens")
    one, none = plain_counts(["new one", ""], path)
    assert got == {1: (999,), 2: (one,), 3: (one,), None: (none,), 4: (none,)}
    assert cache.stored(of).count() == 7
    assert token_counts.count(second, cache).count() == 5 and cache.stored(of).count() == 7
    # a batch that was written twice changes nothing, and another version has counts of its own
    cache.append(cache.stored(of), of)
    assert token_counts.count(second, cache).count() == 5
    assert cache.stored("another") is None


@pytest.mark.parametrize("kind", ["toxicity", "token_counts"])
def test_python_workers_drop_what_another_module_remembered(spark, kind):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")

    def probe():
        def step(cols):
            import gc

            from fathom.llm.token_counts import Counter
            from fathom.llm.toxicity import Windows

            return {"n": [sum(isinstance(x, Counter | Windows) for x in gc.get_objects())] * len(cols["doc_id"])}

        return step

    if kind == "toxicity":
        assert toxicity.measure(docs, {"toxic": b" toxic ", "ordinary": b" ordinary "}).count() == 8
    else:
        assert token_counts.encoded(docs.selectExpr("cast(text as binary) AS digest", "text"), token_counts.tokenizer_path()).count() == 8
    assert {r["n"] for r in map_rows(docs, probe, "n long").collect()} == {0}


def test_files_go_by_the_number_of_counts(spark, monkeypatch):
    """Executors start processes for each file that they write; many shuffle partitions must not make many files."""
    texts = [f"text {i % 90} {'x' * (i % 90)}" for i in range(120)]
    cache, path, n = token_counts.own_cache(spark), token_counts.tokenizer_path(), dict(enumerate(plain_counts(texts, token_counts.tokenizer_path())))
    of = token_counts.version(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, held):
        few = token_counts.count(df, cache)
        assert rows(few, "doc_id", "n_tokens") == {i: (x,) for i, x in n.items()}
        assert len(cache.stored(of).inputFiles()) == 1 and few.rdd.getNumPartitions() < 60
        monkeypatch.setattr(token_counts, "FILE_ROWS", 40)
        monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 80)
        other = token_counts.own_cache(spark)
        assert rows(token_counts.count(df, other), "doc_id", "n_tokens") == {i: (x,) for i, x in n.items()}
        assert len(other.stored(of).inputFiles()) == 4


def test_token_counts_with_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").selectExpr("*", *EXTRA.split(", "))
    assert token_counts.count(df, token_counts.own_cache(spark)).count() == 3
    assert token_counts.count(df.limit(0), token_counts.own_cache(spark)).count() == 0


def test_token_counts_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = dict(zip(texts, plain_counts(texts.values(), token_counts.tokenizer_path()), strict=True))
    assert rows(query_token_counts.query(spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit") == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts.items()}


def plain_audit(docs, labels):
    """{(part, order, step): counts} by applying the filters one after another."""
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", i), i)
    fails, parts = {}, {}
    for i, t, lang in docs:
        w, t = words(t), t or ""
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": first[t] < i}
        fails[i] = {f for f in bad if bad[f]}
        parts.setdefault(lang or "", []).append(i)
    out = {}
    for part, ids in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(ids)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                earlier = [i for i in ids if f in fails[i] and i not in left]
                left = [i for i in left if f not in fails[i]]
                total[f] += len(gone)
                mark = lambda k, gone=gone: sum(labels.get(i, (0, 0))[k] == 1 for i in gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(earlier), sum(fails[i] == {f} for i in ids), mark(0), mark(1))
        for (p, order, step), x in list(out.items()):
            if p == part:
                out[p, order, step] = (*x, total[order[step - 1]])
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    marks = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, good int, toxic int")
    made = filter_audit.audit(filter_audit.failures(df, "lang", marks), "part", filter_audit.FILTERS, ["good", "toxic"])
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in made.collect()}


def test_filter_audit(spark):
    rng = random.Random(6)
    docs, labels = [], {}
    for i, t in enumerate([*HARD, *HARD]):
        docs.append((i, t, rng.choice(["en", "de", None, ""])))
    for i in range(100, 400):
        w = [f"w{rng.randint(0, rng.choice([60, 5000]))}" for _ in range(rng.choice([20, 110, 130]))]
        t = " ".join(w) + rng.choice(["", "", " #", " WORDS IN CAPITALS" * 20])
        docs.append((i, rng.choice([t, docs[-1][1]]), rng.choice(["en", "de", None])))
        if rng.random() < 0.7:
            labels[i] = (rng.randint(0, 1), rng.randint(0, 1))
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_filter_audit_hands_on_partial_arrays(spark, monkeypatch):
    """Many parts, of which a task holds few, and batches that are counted in several steps."""
    monkeypatch.setattr(filter_audit, "HELD", 2)
    monkeypatch.setattr(filter_audit, "PLACES", 500)
    docs = [(i, f"text {i % 7} #" if i % 3 else None, f"part{i % 9}") for i in range(90)]
    assert audited(spark, docs, {}) == plain_audit(docs, {})


def test_filter_audit_of_other_filters(spark):
    df = spark.createDataFrame([("p", True, False), ("p", True, True), ("q", None, True)], "g string, x boolean, y boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.audit(df, "g", ["x", "y"]).collect()}
    assert got["p", "xy", 1] == ("x", 0, 2, 0, 3) and got["p", "xy", 2] == ("y", 0, 0, 1, 1)
    assert got["p", "yx", 1] == ("y", 1, 1, 0, 1) and got["q", "yx", 1] == ("y", 0, 1, 0, 2)
    assert filter_audit.first_failures(2).tolist() == [[2, 2], [0, 1], [1, 0], [0, 0]]


def test_filter_audit_with_nulls_repeats_clashes_and_empty_tables(spark):
    base = [(None, "t", "en"), (None, "t", "en"), (1, "t", "en"), (1, "t", "en"), (2, None, None)]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string").selectExpr("*", *EXTRA.split(", "))
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, good int")
    made = filter_audit.audit(filter_audit.failures(df, "lang", marks), "part", filter_audit.FILTERS, ["good"])
    got = {(r["part"], r["filter_order"], r["step"]): r for r in made.collect()}
    assert len(got) == 2 * 600
    e = got["en", "EABCD", 1]
    assert (e["kept"], e["removed"], e["good_lost"]) == (2, 2, 2)
    none = filter_audit.failures(df.limit(0), "lang", marks)
    assert filter_audit.audit(none, "part", filter_audit.FILTERS, ["good"]).count() == 0


def test_filter_audit_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    names = ("part", "filter_order", "step", *COLUMNS)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({query_filter_audit.ORACLE})").fetchall()
    got = [tuple(r[c] for c in names) for r in query_filter_audit.query(spark, sf).collect()]
    assert sorted(got) == sorted(expected)
