"""Plug-in models: embedding and reranking of rows in Arrow batches, with deterministic defaults that need no files."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as X


@dataclass(frozen=True)
class HashingEmbedder:
    """Feature hashing of lower-case words into `dim` components, at length 1."""

    dim: int = 384
    name: str = "hashing"

    def __call__(self, texts: list[str], mode: str = "document") -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", (text or "").lower())
            h = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint32, count=len(words))
            # sums of ones, which are exact in any order
            row[:] = np.bincount(h % self.dim, np.where(h >> 31, 1.0, -1.0), self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms < 1e-10, 1, norms)).tolist()


def embed(df: DataFrame, text_col: str, mode: str = "document", model=None, out: str = "embedding", most_chars: int | None = None) -> DataFrame:
    """df with an embedding of each text; a model is any callable (texts, mode) -> vectors, loaded once a task. With most_chars, the bound of a request check, longer texts are an error of the caller and get null."""
    model = model or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: pd.Series) -> pd.Series:
        return pd.Series([None if most_chars and t is not None and len(t) > most_chars else v for t, v in zip(batches, model(batches.fillna("").tolist(), mode), strict=True)])

    return df.withColumn(out, run(F.col(text_col)))


def recommended(registry: DataFrame, language: str | None = None, prefer_gpu: bool = True, k: int = 5) -> DataFrame:
    """The best k of models (name, languages, is_gpu_supported, benchmark_score) for a language."""
    rows = registry if language is None else registry.filter(F.coalesce(F.array_contains("languages", language), F.lit(False)))
    rows = rows.filter("is_gpu_supported") if prefer_gpu else rows
    return rows.orderBy(F.desc(F.coalesce("benchmark_score", F.lit(0.0))), "name").limit(k)


def overlap_score(query: str, text: Column) -> Column:
    """The share of the query's distinct terms that the text has: the default reranking score, in [0, 1]."""
    wanted = F.array_distinct(X.tokens(F.lit(query)))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(X.tokens(text), wanted)) / F.size(wanted))


def scored(df: DataFrame, query: str, text_col: str, scorer=None, out: str = "rerank_score") -> DataFrame:
    """df with a relevance score per row; a scorer is any callable (query, texts) -> logits, which a sigmoid takes to [0, 1]."""
    if scorer is None:
        return df.withColumn(out, overlap_score(query, F.col(text_col)))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.fillna("").tolist()), dtype="float64")

    return df.withColumn(out, 1 / (1 + F.exp(-run(F.col(text_col)))))


#: Limits of a request.
MOST_TEXTS, MOST_CHARS = 256, 32_000


def request_error(texts: Column, name: str, most: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Column:
    """What is wrong with the texts of a request, the first thing that is; null if nothing is."""
    long = F.filter(F.transform(texts, lambda t, i: F.when(F.length(t) > most_chars, i)), lambda i: i.isNotNull())
    return (
        F.when(texts.isNull(), f"{name} is required")
        .when(F.size(texts) == 0, f"{name} array cannot be empty")
        .when(F.size(texts) > most, f"{name} array cannot exceed {most} items")
        .when(F.exists(texts, lambda t: t.isNull()), f"{name} must be an array of strings")
        .when(F.size(long) > 0, F.concat(F.lit(f"{name}["), F.get(long, F.lit(0)).cast("string"), F.lit(f"] exceeds maximum length of {most_chars} characters")))
    )


def embed_requests(requests: DataFrame, mode: str = "query", model=None) -> DataFrame:
    """Rows (request_id, input: array of texts) to (request_id, index, embedding, error): a row per text, or one with the error of a request that is refused."""
    judged = requests.select("request_id", "input", request_error(F.col("input"), "input").alias("error"))
    each = judged.filter("error is null").select("request_id", F.posexplode("input").alias("index", "text"))
    made = embed(each, "text", mode, model).select("request_id", "index", "embedding", F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    return made.unionByName(judged.filter("error is not null").select("request_id", none.cast("int").alias("index"), none.cast("array<float>").alias("embedding"), "error"))


def rerank_requests(requests: DataFrame, scorer=None) -> DataFrame:
    """Rows (request_id, query, documents: array of texts, top_n) to (request_id, rank, index, relevance_score, error).

    The best top_n documents of each request, all where it is null, ties by place; a request that is refused has one row with its error.
    scorer: any callable (queries, texts) -> logits, which a sigmoid takes to [0, 1]; by default the share of the query's terms.
    """
    error = F.when(F.col("query").isNull(), "query is required and must be a string").otherwise(request_error(F.col("documents"), "documents"))
    judged = requests.withColumn("error", error)
    if scorer is None:
        wanted = F.array_distinct(X.tokens(F.col("query")))
        each = judged.filter("error is null").select("request_id", "top_n", wanted.alias("wanted"), F.posexplode("documents").alias("index", "text"))
        share = F.size(F.array_intersect(X.tokens(F.col("text")), "wanted")) / F.size("wanted")
        each = each.withColumn("relevance_score", F.when(F.size("wanted") == 0, 0.0).otherwise(share))
    else:

        @F.pandas_udf("double")
        def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series(scorer(queries.tolist(), texts.tolist()), dtype="float64")

        each = judged.filter("error is null").select("request_id", "top_n", "query", F.posexplode("documents").alias("index", "text"))
        each = each.withColumn("relevance_score", 1 / (1 + F.exp(-run("query", "text"))))
    # a request has MOST_TEXTS documents at most
    best = Window.partitionBy("request_id").orderBy(F.desc("relevance_score"), "index")
    ranked = each.withColumn("rank", F.row_number().over(best)).filter("top_n is null or rank <= top_n")
    refused = judged.filter("error is not null").select("request_id", "error")
    return ranked.select("request_id", "rank", "index", "relevance_score").unionByName(refused, allowMissingColumns=True)
