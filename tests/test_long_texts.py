"""Functions whose work is linear in a text: against plain versions, and on texts of hundreds of thousands of characters."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.functions.fixed_values import HIERARCHICAL_PROMPT
from fathom.operators import chunking, context, graph


def fenced_lines(text):
    inside, out = False, []
    for n, line in enumerate((text or "").split("\n"), 1):
        fence = line.lstrip(" ").startswith("```")
        out.append((n, line, fence or inside))
        inside ^= fence
    return out


def test_lines_and_fences(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "```", "```\n", "\n```", "```\n```\n```", "a\n ```py\nb\n```\n", "\t```\nx", "``` ```\n# x", "x ```\ny", "\r\n```\r\nz"]
    texts += ["\n".join(rng.choice(["", "a", "```", " ```x", "``", "\t```", "# h", "é ``` b"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in graph.lines(df, "id", "t").collect():
        got.setdefault(r["id"], []).append((r["line"], r["text"], r["fenced"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: fenced_lines(t) for i, t in enumerate(texts)}


def test_windows_and_pairs_of_characters(spark):
    texts = [None, "", "a", "ab", "a b\ncé", "\U0001f600x日本\U0001f600", "w " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: (r["w"], r["p"]) for r in df.select("id", chunking.character_windows(F.col("t"), 4, 1).alias("w"), X.bigrams(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        bare = "".join((t or "").split())
        assert got[i] == ([t[k : k + 4] for k in range(0, len(t), 3)] if t else [], sorted(bare[k : k + 2] for k in range(len(bare) - 1)))


@pytest.mark.parametrize("name", ["fences", "windows", "pairs"])
def test_long_texts_take_linear_time(spark, name):
    make = {
        "fences": (lambda n: "é\n```\n" * n, lambda df: graph.lines(df, "id", "t").agg(F.count("*"))),
        "windows": (lambda n: "é b " * n, lambda df: df.select(F.size(chunking.character_windows(F.col("t"), 100, 10)))),
        "pairs": (lambda n: "é日bc" * n, lambda df: df.select(F.size(X.bigrams(F.col("t"))))),
    }
    text, run = make[name]
    took = []
    for n in (1000, 10_000, 80_000):
        df = spark.createDataFrame([(1, text(n))], "id long, t string")
        began = time.perf_counter()
        assert run(df).first()[0] > 0
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1] + 8


def test_prompt_and_projection(spark):
    built = spark.createDataFrame([("the context",)], "context string")
    asked = context.prompt(built, "what?").first()[0]
    assert asked == "基于以下知识库内容回答问题：\n\nthe context\n\n问题：what?\n\n请根据上述内容提供准确、详细的回答，并在回答中引用来源。"
    assert context.prompt(built, "{context}", HIERARCHICAL_PROMPT).first()[0].startswith("基于以下上下文回答问题：\n\nthe context\n\n问题：{context}\n\n请基于")
    rows = spark.createDataFrame([("a/b.md", 3, 3, 0.0, 0.5), ("c.md", 1, 9, None, -0.1)], "path string, start_line int, end_line int, bm25 double, emb double")
    assert [tuple(r) for r in context.projected(rows).collect()] == [("a/b.md", 3, 3, None, 0.5, "[[b#L3-L3]]"), ("c.md", 1, 9, None, None, "[[c#L1-L9]]")]
