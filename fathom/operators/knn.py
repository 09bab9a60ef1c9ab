"""Nearest neighbours by exact scan, and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import vectors as V
from fathom.operators import vector_blocks
from fathom.sources.tables import spread


def knn(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", metric: str = "l2", where: Column | None = None, ids: DataFrame | None = None, overfetch: int | None = None) -> DataFrame:
    """(id, score, rank) of the k nearest; ties by id. A filter comes first, so that k rows are found if there are k.

    overfetch: take overfetch * k of all vectors first and filter these, which may leave fewer than k.
    """
    rows = vectors
    if overfetch is None:
        rows = rows.filter(where) if where is not None else rows
        rows = rows.join(ids, id_col, "left_semi") if ids is not None else rows
    score = V.from_distance(V.l2_distance(F.col("embedding"), query)) if metric == "l2" else V.cosine(F.col("embedding"), query)
    scored = rows.withColumn("score", score)
    order = [F.desc("score"), F.col(id_col)]
    top = scored.orderBy(*order).limit(k if overfetch is None else k * overfetch)
    if overfetch is not None:
        top = top.filter(where) if where is not None else top
        top = top.join(ids, id_col, "left_semi") if ids is not None else top
        top = top.orderBy(*order).limit(k)
    return top.select(F.col(id_col).alias("id"), "score", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, score, rank) for a set of queries (query_id, query): blocks of vectors meet blocks of queries, and tasks keep k a query before the shuffle."""
    return vector_blocks.nearest(spread(vectors.select(F.col(id_col).alias("id"), "embedding")), queries.select("query_id", "query"), k)


def vector_stats(vectors: DataFrame, group: str = "model", updated: str | None = None) -> DataFrame:
    """(group, n_vectors, dimension, bytes) and, with the name of a time column, last_update."""
    n, d = F.count("*"), F.max(F.size("embedding"))
    last = [F.max(updated).alias("last_update")] if updated else []
    return vectors.groupBy(group).agg(n.alias("n_vectors"), d.cast("long").alias("dimension"), V.storage_bytes(n, d).alias("bytes"), *last)


def weighted_mean(vectors: DataFrame, group: str, weight: Column, normalize: bool = True) -> DataFrame:
    """(group, embedding): the weighted mean of each group's vectors, component by component with partial sums, at length 1."""
    parts = vectors.select(group, weight.alias("w"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(group, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    made = means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return made.withColumn("embedding", V.l2_normalize(F.col("embedding"))) if normalize else made


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", block: str | None = None) -> DataFrame:
    """(a, b, similarity) with a < b and cosine of at least threshold, of all pairs, within the values of `block` if given."""
    return vector_blocks.near_pairs(vectors.select(F.col(id_col).alias("id"), (F.col(block) if block else F.lit(0)).alias("block"), "embedding"), threshold)
