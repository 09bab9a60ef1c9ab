"""Operators against plain versions and exact round trips, on texts that are hard on them."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fathom.llm import batches, chat_format, decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, storage, substring_dedup, toxicity, url_filter
from tests.llm import brute

VOCABULARY = [f"word{i}" for i in range(60)]
HARD = [None, "", " \t\n", "a", "a", "A b", "a b c", "\x00", "x" * 30000, "é ß \U0001f600 中文 ﬁ", "w " * 3000, "\n" * 500]


def corpus(seed=5, groups=25, edits=0.03, longest=160):
    rng = random.Random(seed)
    texts = list(HARD)
    for _ in range(groups):
        base = [rng.choice(VOCABULARY) + rng.choice(["", ".", "\n"]) for _ in range(rng.randint(5, longest))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, int(len(w) * edits)))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


def rows(df, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join(docs, width, num, den):
    assert rows(ngram_join.join(docs, width, num, den), "doc_id", "n_shingles", "component_id") == brute.components(corpus(), width, num, den)


def test_ngram_join_finds_links_that_no_leader_has(spark):
    # a chain in one bucket: the first links with few of the others, which link among themselves
    rng = random.Random(2)
    base = [rng.choice(VOCABULARY) + str(i) for i in range(120)]
    texts = []
    for k in range(40):
        w = list(base)
        for p in range(k // 2 * 2, k // 2 * 2 + 2):
            w[3 * p % 120] = f"new{p}"
        for p in range(k // 8):
            w[(7 * p + 1) % 120] = f"shared{p}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(ngram_join.join(df), "doc_id", "n_shingles", "component_id") == brute.components(texts, 3, 90, 100)


@pytest.mark.parametrize("group", [1000, 7, 1])
def test_substring_dedup(spark, docs, group):
    rng = random.Random(9)
    passage = " ".join(rng.choice(VOCABULARY) for _ in range(70))
    more = [(1000 + i, f"own{i} words {i} " * 9 + passage + f" tail{i} " * 5) for i in range(12)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = rows(substring_dedup.digest(substring_dedup.dedup(df, group=group)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.windows_removed(corpus() + more, 50)


def test_saved_tables_hand_small_batches_to_python(spark):
    """40 MB of texts of one task come in batches of about 4 MB."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    got = storage.save(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in got) == 4000 and max(r["bytes"] for r in got) < 5e6
    assert spark.conf.get(name) == before


def test_suffix_tree():
    rng = random.Random(4)
    for _ in range(40):
        texts = [[rng.randint(0, 1) for _ in range(rng.randint(7, 25))] for _ in range(5)]
        tree = substring_dedup.SuffixTree(np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts]), 7)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 6)]
        nodes = tree.nodes(np.array([begin[k] + i for k, i in starts]), 7).tolist()
        windows = [tuple(texts[k][i : i + 7]) for k, i in starts]
        assert len(set(zip(nodes, windows))) == len(set(nodes)) == len(set(windows))


def test_substring_dedup_small_windows(docs):
    got = rows(substring_dedup.digest(substring_dedup.dedup(docs, 30, prefixes=(10, 20), group=3)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.windows_removed(corpus(), 30)


def test_pii_base(spark):
    rng = random.Random(1)
    texts = [None, "", "a..b@c.d", "a@b.c%d@e.f.g", "x@-.-", "@@a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4", "1  2", "+1 (234) 567-8901.", "++1+12345678901"]
    texts += ["".join(rng.choice("aB1.@-+ %4(é\U0001f600\ue000") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["1 " * 20000, "a@b" + ".c" * 10000, "a" * 40000, "1." * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(pii.digest(pii.detect(df)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for i, t in enumerate(texts):
        spans = brute.personal(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert got[i] == (*(sum(s[0] == k for s in spans) for k in pii.KINDS), digest), repr(t)[:100]


def test_pii_terms_that_disclose(spark):
    texts = [f"number {i}: call zanzibar desk{i % 2} now at anna@corp.org because of case{i} today" for i in range(6)]
    texts += [f"plain note {i} about now and today and the number of things" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(df)
    spans = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["term"]} for r in found.collect()}
    assert all("zanzibar" in spans[i] and "today" not in spans[i] and "number" not in spans[i] for i in range(6))
    assert not any(spans[i] for i in range(6, 66))
    clean = rows(pii.sanitize(df, found), "doc_id", "text")
    assert "[EMAIL]" in clean[0][0] and "zanzibar" not in clean[0][0] and clean[10][0] == texts[10]


@pytest.mark.parametrize("case", ["once", "rows three times", "other ids", "no ids", "an id with two texts"])
def test_pii_terms_equal_those_of_distinct_texts(spark, case):
    texts = [f"number {i}: call zanzibar desk{i % 2} now at anna@corp.org because of case{i} today" for i in range(6)]
    texts += [f"note {i} about today and the number of things, mail bob{i % 3}@x.org or +1 555 123 {1000 + i}" for i in range(40)] + ["", "  "]
    rows_of = list(enumerate(texts))
    rows_of = {"once": rows_of, "rows three times": rows_of * 3, "other ids": rows_of + [(i + 1000, t) for i, t in rows_of], "no ids": [(None, t) for _, t in rows_of * 2], "an id with two texts": rows_of + [(3, texts[1]), (3, "one more text of 3")]}[case]
    found = pii.detect(spark.createDataFrame(rows_of, "doc_id long, text string")).join(spark.createDataFrame([(t,) for t in dict(enumerate({t for _, t in rows_of})).values()], "x string").selectExpr("x", "xxhash64(x) AS th"), "th")
    expected = brute.disclosing([t for _, t in rows_of])
    for r in found.collect():
        outside = {w for w in expected[r["x"]] if not any(w in r["x"][s["start"] : s["end"]] for s in r["base"])}
        assert {r["x"][s["start"] : s["end"]] for s in r["term"]} == outside
    assert any(expected.values())


def test_pii_of_a_long_text_with_very_many_spans(spark):
    """Spans, contexts and the sanitised text of 40,000 addresses in one text, in nearly linear time."""
    import time

    took = {}
    for n in (4000, 40_000):
        text = " ".join(f"é{i} a{i}@b.c{'x' * (i % 3)}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        found = pii.detect(df)
        r = found.first()
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == brute.personal(text)
        clean = pii.sanitize(df, found).first()["text"]
        assert clean == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
        took[n] = time.perf_counter() - began
    assert took[40_000] < 15 * took[4000] + 15


def test_substring_dedup_of_one_word_repeated(spark):
    """Texts of very many equal words, alone and with others: one suffix for all their windows, and few words kept."""
    texts = [(1, "w " * 60_000), (2, "w " * 200_000), (3, "own " * 30 + "w " * 70), (4, "v " * 49), (5, "ab cd " * 40_000), (6, "cd ab " * 100)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for group in (1000, 1):
        got = rows(substring_dedup.digest(substring_dedup.dedup(df, group=group)), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == brute.windows_removed(texts, 50)
    held = substring_dedup.runs(np.zeros(200_000 - 49, dtype=np.uint64))
    assert len(held) == -(-(200_000 - 49) // substring_dedup.PIECE) and sum(b - a for a, b in held) == 200_000 - 49


def test_quality_base(spark, docs):
    df = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source")
    got = rows(quality_rules.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in corpus()}


def test_quality_estimates_converge_or_fail(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(VOCABULARY) + "#" * rng.randint(0, 3) for _ in range(rng.randint(20, 300))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    stats = quality_rules.vectors(quality_rules.statistics(df)).selectExpr("*", "1L AS g")
    with pytest.raises(RuntimeError, match="not converged"):
        quality_rules.estimates(stats, 1)
    assert quality_rules.estimates(stats).count() == 1


def test_quality_outliers(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 999)) for _ in range(rng.randint(40, 90))) for _ in range(120)]
    texts += [" ".join("%$#" + w for w in t.split()) for t in texts[:5]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = rows(quality_rules.judge(df), "doc_id", "kept")
    assert all(kept[i][0] for i in range(120)) and not any(kept[i][0] for i in range(120, 125))


def test_quality_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "g long, x0 double, x1 double, x2 double, x3 double")
    cov = np.cov(x.T, bias=True)
    m = x.mean(axis=0)
    row = spark.createDataFrame([(1, *map(float, m), *(float(cov[i, j]) for i, j in quality_rules.PAIRS))], "g long, " + ", ".join([f"m{i} double" for i in range(4)] + [f"c{i}{j} double" for i, j in quality_rules.PAIRS]))
    estimate = quality_rules.factored(row)
    assert np.isclose(estimate.first()["det"], np.linalg.slogdet(cov)[1])
    got = [r["d2"] for r in quality_rules.with_distance(df, estimate).collect()]
    assert np.allclose(sorted(got), sorted(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)))


def test_quality_estimate_has_a_small_determinant(spark):
    # a third of the rows far off: the half that the estimate takes has to leave them out, and no random start does better
    rng = np.random.default_rng(1)
    good, far = rng.normal(size=(200, 4)) * 0.5 + 1, rng.normal(size=(100, 4)) * 0.1 + 6
    x = np.vstack([good, far])
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "g long, x0 double, x1 double, x2 double, x3 double").repartition(5)
    found = quality_rules.estimates(df).first()
    assert quality_rules.estimates(df.orderBy("x3")).first() == found or np.isclose(quality_rules.estimates(df.orderBy("x3")).first()["det"], found["det"])

    def floored(rows):
        c = np.cov(rows.T, bias=True) * quality_rules.CONSISTENCY
        np.fill_diagonal(c, (np.sqrt(np.diag(c)) + quality_rules.FLOOR) ** 2)
        return c

    best = np.inf
    for k in range(200):
        rows_of = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(10):
            m, c = rows_of.mean(axis=0), floored(rows_of)
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            rows_of = x[np.argsort(d2)[:150]]
        best = min(best, np.linalg.slogdet(floored(rows_of))[1])
    assert found["det"] < best + 0.15
    d2 = np.array([r["d2"] for r in quality_rules.with_distance(df.filter("x0 > 4"), quality_rules.estimates(df)).collect()])
    assert len(d2) == 100 and (d2 > quality_rules.CUTOFF).all()


def test_quality_middles_are_exact(spark):
    rng = random.Random(6)
    rows_of = [(k, rng.randint(-3, 9)) for k in range(4) for _ in range(rng.randint(1, 40))]
    got = rows(quality_rules.middles(spark.createDataFrame(rows_of, "g int, step int"), ["g"]), "g", "at")
    for k in range(4):
        s = sorted(b for a, b in rows_of if a == k)
        assert got[k] == (s[(len(s) + 1) // 2 - 1],)


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<sep/>", "\\", "[", "<", "ok", "\n", "é", "<\\s>", "[\\\\/INST]"]
    turns = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            turns.append((c, t, rng.choice(["user", "assistant", "system", None, "[/INST]"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))])))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(df)).collect()
    assert len(back) == 60
    for r in back:
        mine = sorted((t, a or "", b or "") for c, t, a, b in turns if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(a, b) for _, a, b in mine]
        assert r["loss_text"] == "".join(b for _, a, b in mine if a == "assistant")


def test_decontaminate(spark, docs):
    rng = random.Random(8)
    long_item = [rng.choice(VOCABULARY) for _ in range(30)]
    items = [(1, " ".join(long_item)), (2, "Word1 word2"), (3, ""), (4, None), (5, " ".join(long_item[5:20])), (5, " ".join(long_item[5:20])), (7, "a")]
    more = [(500, "x " + " ".join(long_item[3:17]).upper() + " y"), (501, " ".join(long_item[:9])), (502, "word1, word2!")]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    it = spark.createDataFrame(items, "item_id long, text string")
    expected = {i: (n, h, hashlib.sha256(",".join(x).encode()).hexdigest(), len(x)) for i, (n, h, x) in brute.contaminated(corpus() + more, items, 10).items()}
    for size in (8_000_000, 200):  # in one automaton, and in several
        got = decontaminate.digest(decontaminate.hits(df, it, shard_chars=size))
        assert rows(got, "doc_id", "n_words", "n_hit", "items_sha256", "n_items") == expected


def test_decontaminate_cuts_only_hits(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [(1, "before the start. " + passage + ", and after  it"), (2, passage), (3, "clean\ttext ")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    got = rows(decontaminate.clean(df, spark.createDataFrame([(9, passage)], "item_id long, text string")), "doc_id", "text", "n_chars")
    assert got == {1: ("before the start. , and after  it", 33), 3: ("clean\ttext ", 11)}


def test_lines_are_removed_without_python(spark):
    """Each chained Python step holds a worker of its own; a filter on the text of the result had doubled them."""
    rng, held = random.Random(8), []
    for i in range(300):
        lines = ["".join(rng.choice("ab é\t\r€|.\x00\x85\U0001f600") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 9))]
        held.append((i, "\n".join(lines), sorted(rng.sample(range(len(lines)), rng.randint(0, len(lines))))))
    df = spark.createDataFrame(held, "doc_id long, text string, gone array<int>")
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", line_dedup.without(df["text"], df["gone"]).alias("t")).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) for i, t, gone in held}
    block = "one two three four five six\nseven eight nine ten eleven"
    made = line_dedup.dedup(spark.createDataFrame([(1, block), (2, f"x\n{block}"), (3, None)], "doc_id long, text string"), "n").filter("n = 0 or text rlike '[^ ]'")
    assert sorted(map(tuple, made.collect())) == [(1, block, 0), (2, "x", 2), (3, None, 0)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan


def test_line_dedup(spark):
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(8))
    texts = [
        (1, "\n".join([line(1), line(2), "", line(3)])),
        (2, "\n".join(["own one two three four", line(2), "", line(3), "own five six seven"])),
        (3, "\n".join([line(1), line(2), "", line(3)])),
        (4, "short line\n" + line(9)),
        (5, "short line\n" + line(8)),
        (6, None),
        (7, ""),
        (7, ""),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS th", "'y' AS lines", "1L AS d")
    got = {(r["doc_id"], r["text"], r["gone"]) for r in line_dedup.dedup(df, "gone").collect()}
    assert got == {(1, texts[0][1], 0), (2, "own one two three four\nown five six seven", 3), (3, "", 4), (4, texts[3][1], 0), (5, texts[4][1], 0), (6, None, 0), (7, "", 0)}


def test_patience_matches_in_order():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 15))] for _ in range(2))
        matched = line_dedup.patience(a, b)
        at = 0
        for j in matched:  # the matched lines are a common subsequence
            at = a.index(b[j], at) + 1
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [0, 2, 3]


@pytest.mark.parametrize("room", [1 << 28, 40])
def test_lines_that_stand_twice_are_matched(room, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROOM", room)
    assert line_dedup.patience([1, 2, 8, 1, 2], [9, 1, 2, 7]) == [1, 2]
    assert line_dedup.blocks([9, 1, 2, 7], [6, 1, 2, 8, 1, 2, 5], [5] * 7, 10) in ([1, 2], [4, 5])
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        found, at = line_dedup.lcs(a, b), 0
        assert len(set(found)) == length[-1][-1]
        for j in found:
            at = a.index(b[j], at) + 1


def places_gone(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return {r["d"]: set(r["gone"] or []) for r in line_dedup.removals(df).collect()}


def test_blocks_whose_lines_have_other_owners(spark):
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(6))
    own = iter(range(1000, 2000))
    text = lambda *ks: "\n".join(line(k if k else next(own)) for k in ks)
    texts = [(1, text(0, 1, 0)), (2, text(0, 2, 0)), (5, text(0, 1, 2, 0)), (9, text(1, 2, 0, 0))]
    texts += [(20, text(31, 32, 0, 41, 42, 51, 52)), (21, text(41, 42, 0, 51, 52, 0, 31, 32, 0, 41, 42))]
    assert places_gone(spark, texts) == {1: set(), 2: set(), 5: set(), 9: {0, 1}, 20: set(), 21: {0, 1, 3, 4, 6, 7, 9, 10}}


def test_five_documents_whose_lines_have_other_owners(spark):
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(5))
    texts = [(k, f"own{k} of it here now\n" + line(k)) for k in (1, 2, 3)] + [(k, "\n".join([f"own{k} of it here now", *map(line, (1, 2, 3))])) for k in (4, 5)]
    gone = places_gone(spark, texts)
    assert gone == {1: set(), 2: set(), 3: set(), 4: set(), 5: {1, 2, 3}}


@pytest.mark.parametrize("seed", range(3))
def test_line_removals_equal_those_of_all_pairs(spark, seed):
    # blocks stand with and without other lines between theirs, in few documents and in many
    rng, serial = random.Random(seed), iter(range(10**6))
    fresh = lambda: " ".join(f"u{next(serial)}" for _ in range(rng.randint(4, 7)))
    pool = [[fresh() for _ in range(rng.randint(2, 5))] for _ in range(12)]
    short = [f"s{k} t{k} v{k}" for k in range(9)]
    texts = []
    for i in range(60):
        lines = [fresh() for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(pool))
            for x in pool[k]:
                lines += [x, *([fresh()] if rng.random() < 0.25 else []), *([""] if rng.random() < 0.2 else [])]
        if rng.random() < 0.5:
            lines += [rng.choice(short) for _ in range(rng.randint(1, 9))]
        texts.append((i, "\n".join(lines)))
    sizes = {i: [len(x.split()) for x in t.split("\n")] for i, t in texts}
    got = {i: {p for p in gone if sizes[i][p]} for i, gone in places_gone(spark, texts).items()}
    assert got == brute.line_removals(texts, 10, line_dedup.blocks) and sum(map(len, got.values())) > 20


@pytest.mark.parametrize("holders", [1, 3, 6, 40])
def test_a_block_that_was_broken_before_goes_however_many_hold_its_lines(spark, holders):
    a, b = "first line of six words here", "second line of five words"
    texts = [(i, f"own{i} x\n{a}\nown{i} y") for i in range(holders)] + [(100 + i, f"own{i} z\n{b}") for i in range(holders)]
    texts += [(200, f"{a}\nmid\n{b}"), (300, f"{a}\n{b}\ntail"), (301, f"{b}\n{a}\ntail")]
    gone = places_gone(spark, texts)
    assert gone[300] == {0, 1} and not any(gone[i] for i in gone if i != 300)


def test_blocks_of_short_lines(spark):
    verse = [f"verse{k}" for k in range(60)]
    pairs = [f"one{k} two{k}" for k in range(5)]
    texts = [(1, "\n".join(["own", *verse])), (2, "\n".join([*verse, "mine"])), (3, "\n".join([*pairs[:2], "other", *pairs[2:]])), (4, "\n".join(["first", *pairs]))]
    # the last one's block has a line in between where it stood before
    assert places_gone(spark, texts) == {1: set(), 2: set(range(60)), 3: set(), 4: {1, 2, 3, 4, 5}}


def test_no_common_block_stays(spark):
    # every block of ten words that stands in any earlier document, by trying all
    rng = random.Random(11)
    vocabulary = [" ".join(f"v{k}w{j}" for j in range(k % 7)) for k in range(18)]
    texts = [(i, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 14)))) for i in range(40)]
    got, seen = places_gone(spark, texts), set()
    for i, text in texts:
        full = [(p, x.split()) for p, x in enumerate(text.split("\n")) if x]
        runs = [full[s:e] for s in range(len(full)) for e in range(s + 1, len(full) + 1) if sum(len(w) for _, w in full[s:e]) >= 10]
        names = {tuple(" ".join(w) for _, w in run): [p for p, _ in run] for run in runs}
        for run in runs:
            if tuple(" ".join(w) for _, w in run) in seen:
                assert got[i] >= {p for p, _ in run}
        seen |= set(names)


def test_packing(spark, docs):
    encode = packing.Encoder(packing.tokenizer_path())
    got = packing.pack_documents(docs, capacity=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in corpus():
        ids = np.append(np.array(encode.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(0)).astype("<u4")
        found = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in found] == [sum(x["length"] for x in found[:k]) for k in range(len(found))]
        assert sum(r["length"] for r in found) == len(ids) and all(r["length"] == 64 for r in found[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in found)
    for held in by_seq.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:k]) for k in range(len(held))]
        assert sum(r["length"] for r in held) <= 64
    least = -(-sum(r["length"] for r in got) // 64)
    assert len(by_seq) <= least * 1.02 + 1


def test_packing_over_blocks(spark):
    rng = random.Random(6)
    cut = [(i, rng.choice([3, 40, 700, 1100, 1500, 2047, 2048])) for i in range(900)]
    df = spark.createDataFrame(cut, "id long, length long")
    got = packing.pack(df, block=120).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    single = packing.best_fit([n for _, n in cut], sorted(range(900), key=lambda i: -cut[i][1]), [], 2048)
    assert len(got) == 900 and max(fill.values()) <= 2048 and len(fill) <= len(single) * 1.02


def test_crossover_keeps_every_piece():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    a = packing.best_fit(lengths, list(range(200)), [], 100)
    b = packing.best_fit(lengths, sorted(range(200), key=lambda i: -lengths[i]), [], 100)
    child = packing.crossover(lengths, a, b, 100, rng)
    assert sorted(i for held in child for i in held) == list(range(200)) and all(sum(lengths[i] for i in held) <= 100 for held in child)


def test_the_genetic_part_beats_best_fit():
    # sequences of exactly three pieces, which best-fit-decreasing misses
    for seed in range(3):
        rng, lengths = random.Random(seed), []
        for _ in range(40):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1000 - a) // 2)
            lengths += [a, b, 1000 - a - b]
        falling = sorted(range(120), key=lambda i: (-lengths[i], i))
        evolved = packing.evolve(lengths, [], 1000, seed, generations=60, population=6)
        assert len(packing.best_fit(lengths, falling, [], 1000)) - len(evolved) >= 3
        assert sorted(i for held in evolved for i in held) == list(range(120)) and all(sum(lengths[i] for i in held) <= 1000 for held in evolved)


def test_swaps_fill_bins_to_the_last_token():
    lengths = [60, 39, 40, 20, 21]
    bins = [[0, 1]]
    assert packing.fill_up(lengths, bins, [2, 3, 4], 100) == [0, 3] and sorted(bins[0]) == [1, 2, 4]


ENCODED = " \t\n\r\x0b\x85\xa0ab'séªºß,.!?'tllvered0123<|endoftext|>_Àɏ×÷"


@pytest.mark.parametrize("letters", [ENCODED, ENCODED + "\x1c1²½\u2003\u3000中Ω\U0001f600"])
def test_encoder_agrees_with_the_tokenizer(letters):
    rng = random.Random(2)
    encode = packing.Encoder(packing.tokenizer_path())
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert encode(t) == np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_latin_bytes_split_as_texts_do():
    rng = random.Random(3)
    letters = [chr(c) for c in range(256) if not packing._OTHER.search(chr(c))]
    for _ in range(3000):
        t = "".join(rng.choice(letters if rng.random() < 0.5 else " \n'stREvelld1.") for _ in range(rng.randint(0, 60)))
        assert [p.decode("latin-1") for p in packing._PIECE_BYTES.findall(t.encode("latin-1"))] == packing._PIECE.findall(t)
    assert len(letters) + len(packing._OTHER_BYTES) == 256


@pytest.mark.parametrize("letters", [ENCODED, ENCODED + "\x1c½\u3000中", " \na'sé1.", "'stREvelld1 \n", " \n"])
def test_texts_that_are_encoded_together_get_the_ids_of_each(letters):
    rng = random.Random(4)
    encode = packing.Encoder(packing.tokenizer_path())
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 5, 40)))) for _ in range(rng.randint(0, 9))]
        assert encode.many(texts) == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_pieces_of_many_texts_are_looked_up_once(monkeypatch):
    encode, asked = packing.Encoder(packing.tokenizer_path()), []
    monkeypatch.setattr(packing._Known, "__missing__", lambda self, piece: asked.append(piece) or b"\x01\0\0\0")
    assert encode.many(["it's one.\ntwo, two", "two one"] * 50) == [b"\x01\0\0\0" * 8, b"\x01\0\0\0" * 2] * 50
    assert sorted(asked) == sorted([b"it", b"'s", b" one", b".", b"\n", b"two", b",", b" two"])


def test_pieces_asked_for_again_outlive_others(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 8)
    encode, asked = packing.Encoder(packing.tokenizer_path()), []
    tokenize = encode.known.model.tokenize
    encode.known.model = type("Model", (), {"tokenize": lambda self, x: asked.append(x) or tokenize(x)})()
    for k in range(30):
        assert encode(f"often a{k}") == encode.whole(f"often a{k}") and len(encode.known) + len(encode.known.before) <= 8
    assert asked.count("often") == 1


def test_pieces_are_encoded_once():
    encode = packing.Encoder(packing.tokenizer_path())
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 250_000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    first = [encode(t) for t in texts]
    assert len(encode.known) >= len(words)
    encode.known.model = None  # a second encoding would fail
    assert [encode(t) for t in texts] == first


def test_other_tasks_find_nothing_of_packing(spark, docs):
    # one worker takes both tasks, one after the other
    assert packing.pieces(docs.coalesce(1)).count() > 0

    def make():
        return lambda cols: {"n": [sum(len(held) for module, held in batches._kept.items() if module == packing.__name__) for _ in cols["doc_id"]]}

    assert {r["n"] for r in batches.map_rows(docs.coalesce(1), make, "n long").collect()} == {0}
    batches.kept("a", "x", dict)["held"] = 1
    assert batches.kept("a", "x", dict) == {"held": 1}
    batches.release("a")
    assert batches.kept("a", "x", dict) == {"held": 1}
    batches.release("b")
    assert batches.kept("a", "x", dict) == {}
    batches.release("b")


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://example.org", "https://x.com/de/1?a=/fr/", "https://com/fr/", None, "no host", "ftp://net", "http://b.net/x#y://z/", "HTTP://x.com/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filter.judge(df), "page_id", "host", "path", "rule", "verdict")
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block") and got[1][2] == "example.org/en/1" and got[2][2:] == ("org/", "allow")
    assert got[3][:3] == ("example.org", "", None) and got[4] == ("x.com", "/de/1", "com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[9][:2] == ("b.net", "/x")


def test_url_reputation(spark):
    outcomes = [("bad.site.net", 1)] * 60 + [("good.site.net", 0)] * 60 + [("one.other.net", 1)] + [("spam.com", 1)] * 300
    pages = spark.createDataFrame([(1, "http://bad.site.net/"), (2, "http://good.site.net/"), (3, "http://one.other.net/"), (4, "http://new.spam.com/"), (5, "http://new.org/")], "page_id long, url string")
    got = rows(url_filter.judge(pages, spark.createDataFrame(outcomes, "host string, blocked int"), rules=()), "page_id", "verdict")
    assert [got[i][0] for i in range(1, 6)] == ["block", "allow", "allow", "block", "allow"]


def toxic_corpus(n=600):
    rng = random.Random(7)
    texts = []
    for i in range(n):
        w = [rng.choice(VOCABULARY) + str(rng.randint(0, 50)) for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["stinker", "blockhead", "nitwit", "dunce"])
        texts.append((i, " ".join(w)))
    return texts, [(i, int(i % 6 == 0)) for i, _ in texts]


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus()
    df, lb = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows(toxicity.score(df, lb), "doc_id", "held_out", "score", "predicted")
    held = [i for i in got if got[i][0]]
    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i][2] == labels[i][1] for i in held) >= 0.95 * len(held)


def test_toxicity_counts_compressed_lengths(spark):
    import zstandard as z

    texts, labels = toxic_corpus(240)
    df, lb = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lb)
    assert toxicity.fit(df.repartition(3), lb) == model
    params = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(word, content):
        held = z.ZstdCompressionDict(content + toxicity.HEAD + toxicity.TAIL, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(dict_data=held, compression_params=params).compress(toxicity.HEAD + f" {word} ".encode() + toxicity.TAIL))

    more = [(1000, "blockheads and a stinkerly one"), (1001, None), (1002, ""), (1003, "word1 word1 WORD1")]
    got = rows(toxicity.measure(spark.createDataFrame(texts[:12] + more, "doc_id long, text string"), model), "doc_id", "n", "counts")
    for i, text in texts[:12] + more:
        words = set((text or "").lower().split())
        saved = [length(w, model["ordinary"]) - length(w, model["toxic"] + model["ordinary"]) for w in words]
        assert got[i] == (len(words), [sum(x >= k for x in saved) for k in range(1, toxicity.SAVED + 1)])
    # words that no text had move the score where they are made like toxic ones
    assert got[1000][1][0] >= 1 and not any("blockheads" in t or "stinkerly" in t for _, t in texts)


def test_toxicity_is_calibrated_on_small_batches(spark, docs, monkeypatch):
    name, seen, measure = "spark.sql.execution.arrow.maxBytesPerBatch", [], toxicity.measure
    before = spark.conf.get(name)
    monkeypatch.setattr(toxicity, "measure", lambda *args: seen.append(spark.conf.get(name)) or measure(*args))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    toxicity.fit(docs, labels)
    assert len(seen) == 2 * len(toxicity.SIZES) and set(seen) == {str(4 << 20)} and spark.conf.get(name) == before


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got)


def test_url_domains_under_suffixes_of_two_labels(spark):
    """Hosts of one company under co.uk share its reputation, those of others don't; hosts that are such a suffix, or less, don't fail. The SQL says the same."""
    import duckdb

    from fathom.llm import query_url

    hosts = [f"h{i}.bad.co.uk" for i in range(6)] + [f"h{i}.good.co.uk" for i in range(6)] + ["co.uk", "uk", "a.com.au", "b.a.com.au", ""]
    outcomes = spark.createDataFrame([(h, 1) for h in hosts[:5] for _ in range(9)] + [(h, 0) for h in hosts[6:11] for _ in range(9)], "host string, blocked int")
    pages = spark.createDataFrame([(i, f"https://{h}/x") for i, h in enumerate(hosts)] + [(90, None)], "page_id long, url string")
    kept = {r["host"]: r for r in url_filter.judge(pages, outcomes, (), two_label_suffixes=url_filter.TWO_LABEL_SUFFIXES).collect()}
    assert kept["h5.bad.co.uk"]["verdict"] == "block" and kept["h5.good.co.uk"]["verdict"] == "allow" and kept["co.uk"]["verdict"] == "allow"
    mixed = {r["host"]: r for r in url_filter.judge(pages, outcomes, ()).collect()}
    assert kept["h5.bad.co.uk"]["block_rate"] > mixed["h5.bad.co.uk"]["block_rate"]
    listed = [(i, f"https://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in [*hosts, "x.org", "y.org", "z.com"] for p in ("de/1", "fr/2", "es/"))] + [(900, None), (901, "x"), (902, "HTTP://www.shop.com.br/de/")]
    got = url_filter.judge(spark.createDataFrame(listed, "page_id long, url string"), two_label_suffixes=url_filter.TWO_LABEL_SUFFIXES)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", listed)
    names = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({query_url.ORACLE})").fetchall())


OPERATORS = {
    "ngram_join": lambda d: ngram_join.join(d),
    "line_dedup": lambda d: line_dedup.dedup(d),
    "pii": lambda d: pii.digest(pii.detect(d)),
    "substring_dedup": lambda d: substring_dedup.digest(substring_dedup.dedup(d)),
    "quality_rules": lambda d: quality_rules.judge(d),
    "decontaminate": lambda d: decontaminate.digest(decontaminate.hits(d, d.selectExpr("doc_id AS item_id", "text"))),
    "toxicity": lambda d: toxicity.score(d, d.selectExpr("doc_id", "1 AS toxic")),
    "chat_format": lambda d: chat_format.format_chats(d.selectExpr("monotonically_increasing_id() AS conv_id", "1L AS turn", "lang AS role", "*")),
    "packing": lambda d: packing.pack_documents(d).filter("piece = 0"),
    "url_filter": lambda d: url_filter.judge(d.selectExpr("doc_id AS page_id", "text AS url", "*")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    base = [(None, "null id and some words here", None, None), (1, None, "en", None), (1, None, "en", None), (2, "same text of words", None, "s"), (2, "same text of words", None, "s"), (3, "", "en", "s"), (4, "y " * 400, "en", "s")]
    extra = "'c' AS th, 'c' AS n, 'c' AS spans, 1 AS prefix, 'c' AS kept, 'c' AS id, 'c' AS component, 'c' AS g, 'c' AS t, 'c' AS a, 'c' AS b"
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, source string").selectExpr("*", *extra.split(", "))
    assert OPERATORS[name](df).count() == len(base)
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_changed_documents_keep_their_other_columns(spark):
    """Whatever the caller's columns are called, they come back as they were."""
    names = ["_d", "_th", "_gone", "_n", "_spans", "_new", "_cut", "row", "t", "th", "spans", "start", "end"]
    passage = " ".join(f"p{i}" for i in range(20))
    base = [(1, passage + "\nmail anna@corp.org"), (2, "own words\n" + passage), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame(base, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", *(f"concat('{c}', doc_id) AS {c}" for c in names))
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    for made in (line_dedup.dedup(df), decontaminate.clean(df, items), pii.sanitize(df, pii.detect(df))):
        assert made.columns == df.columns
        for r in made.collect():
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in names)
            assert r["text"] is None or made.columns and (r["n_chars"] is None or "EMAIL" in r["text"] or r["n_chars"] == len(r["text"]))


def test_native_operators_with_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(chat_format.format_chats(turns)).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
