"""Ranking quality: measures per query over tables of ranked results with judgments, by grouped sums and one window a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ranked(results: DataFrame) -> DataFrame:
    by_gain = Window.partitionBy("query_id").orderBy(F.desc("expected"), "id")
    return results.withColumn("ideal", F.row_number().over(by_gain))


def ndcg(results: DataFrame, k: int | None = None, exponential: bool = False) -> DataFrame:
    """(query_id, ndcg) of rows (query_id, id, rank, expected): gain over the gain of the best order, 0 without any."""
    gain = F.pow(F.lit(2.0), F.col("expected")) - 1 if exponential else F.col("expected")
    at = lambda place: gain / F.log2(F.col(place) + 1) if k is None else F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)).otherwise(0.0)
    sums = _ranked(results).groupBy("query_id").agg(F.sum(at("rank")).alias("dcg"), F.sum(at("ideal")).alias("best"))
    return sums.select("query_id", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def mrr(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, mrr): one over the rank of the first row with expected of at least the threshold."""
    first = results.groupBy("query_id").agg(F.min(F.when(F.col("expected") >= threshold, F.col("rank"))).alias("first"))
    return first.select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def mrr_top(results: DataFrame) -> DataFrame:
    """(query_id, mrr): one over the rank of the best expected row; 0 if nothing is expected."""
    best = results.groupBy("query_id").agg(F.max_by("rank", F.struct("expected", -F.col("rank"))).alias("rank"), F.max("expected").alias("expected"))
    return best.select("query_id", F.when(F.col("expected") > 0, 1.0 / F.col("rank")).otherwise(0.0).alias("mrr"))


def average_precision(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, ap): mean of the precision at each relevant row."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relevant = (F.col("expected") >= threshold).cast("int")
    rows = results.withColumn("rel", relevant).withColumn("found", F.sum("rel").over(so_far))
    sums = rows.groupBy("query_id").agg(F.sum(F.col("rel") * F.col("found") / F.col("rank")).alias("s"), F.sum("rel").alias("n"))
    return sums.select("query_id", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("ap"))


def precision_recall(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) of results (query_id, id) against relevant (query_id, id)."""
    hits = results.join(relevant.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("m"))
    p, r = F.col("tp") / F.col("n"), F.coalesce(F.col("tp") / F.col("m"), F.lit(0.0))
    return sums.join(wanted, "query_id", "left").select("query_id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def errors(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """mae, rmse and pearson (0 where undefined) of score against expected."""
    off = F.col("score") - F.col("expected")
    pearson = F.coalesce(F.nanvl(F.corr("score", "expected"), F.lit(0.0)), F.lit(0.0))
    return results.groupBy(*(group or [])).agg(F.coalesce(F.avg(F.abs(off)), F.lit(0.0)).alias("mae"), F.coalesce(F.sqrt(F.avg(off * off)), F.lit(0.0)).alias("rmse"), pearson.alias("pearson"))


def ranking_accuracy(results: DataFrame, slack: int = 0) -> DataFrame:
    """(query_id, accuracy): rows within `slack` places of where the expected order has them."""
    rows = _ranked(results)
    return rows.groupBy("query_id").agg(F.avg((F.abs(F.col("rank") - F.col("ideal")) <= slack).cast("double")).alias("accuracy"))


def spearman(results: DataFrame) -> DataFrame:
    rows = _ranked(results).groupBy("query_id").agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col("rank") - F.col("ideal"), 2)).alias("d"))
    return rows.select("query_id", F.when(F.col("n") > 1, 1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).otherwise(0.0).alias("rho"))


def keyword_relevant(content: Column, path: Column, keywords: list[str], files: list[str]) -> Column:
    """Whether the content has a keyword, ignoring case, or the path an expected file."""
    hit = F.lit(False)
    for w in keywords:
        hit = hit | F.contains(F.lower(content), F.lit(w.lower()))
    for f in files:
        hit = hit | F.contains(path, F.lit(f))
    return hit


def model_health(self_similarity: Column, high: Column, low: Column) -> Column:
    return F.when((self_similarity > 0.99) & (high > 0.4) & (low < 0.5), "healthy").otherwise("unhealthy")
