"""Fusion of ranked lists and what follows it: filters, debiasing, diversity, merging of tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class FusionOptions:
    """Weights of a fusion; invalid ones give way to the defaults."""

    method: str = "weighted"
    bm25_weight: float = 0.35
    vector_weight: float = 0.65
    k: int = 60

    def validated(self) -> FusionOptions:
        weights = 0 <= self.bm25_weight <= 1 and 0 <= self.vector_weight <= 1
        summed = self.method == "rrf" or abs(self.bm25_weight + self.vector_weight - 1) <= 0.001
        return self if self.k > 0 and weights and summed else FusionOptions(self.method)


def both(bm25: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, bm25, emb, bm25_rank, emb_rank) of two lists (id, score, rank)."""
    left = bm25.select("id", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    right = vector.select("id", F.col("score").alias("emb"), F.col("rank").alias("emb_rank"))
    return left.join(right, "id", "full_outer")


def weighted(bm25: DataFrame, vector: DataFrame, options: FusionOptions = FusionOptions()) -> DataFrame:
    """Each list over its own maximum, then weighted; what misses a list gets 0 from it. Lists are top-k, so the maxima are of few rows."""
    o = options.validated()
    top = lambda df, name: F.broadcast(df.agg(F.max("score").alias(name)).select(F.when(F.coalesce(F.col(name), F.lit(0.0)) > 0, F.col(name)).otherwise(1.0).alias(name)))
    joined = both(bm25, vector).join(top(bm25, "top_bm25")).join(top(vector, "top_emb"))
    score = o.bm25_weight * F.coalesce(F.col("bm25") / F.col("top_bm25"), F.lit(0.0)) + o.vector_weight * F.coalesce(F.col("emb") / F.col("top_emb"), F.lit(0.0))
    return joined.select("id", score.alias("score"), "bm25", "emb")


def rrf(bm25: DataFrame, vector: DataFrame, options: FusionOptions = FusionOptions("rrf")) -> DataFrame:
    """Reciprocal ranks from 0; a hit of one list counts half."""
    k = options.validated().k
    a, b = F.col("bm25_rank") - 1, F.col("emb_rank") - 1
    score = F.when(a.isNotNull() & b.isNotNull(), 1 / (k + a) + 1 / (k + b)).otherwise(0.5 / (k + F.coalesce(a, b)))
    return both(bm25, vector).select("id", score.alias("score"), "bm25", "emb")


def top(df: DataFrame, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("score"), *ties).limit(k)


def sources_filter(df: DataFrame, enabled: list[str], requested: list[str] | None = None, keep_blank: bool = True) -> DataFrame:
    """Rows of enabled (and requested) sources; rows without a source only if keep_blank."""
    allowed = [s for s in enabled if requested is None or s in requested]
    blank = F.coalesce(F.col("source"), F.lit("")) == ""
    return df.filter((blank & F.lit(keep_blank)) | (~blank & F.col("source").isin(*allowed)))


def enabled_sources(configured: DataFrame, files: DataFrame) -> list[str]:
    """Names of the enabled sources of a configuration (source, enabled); of all that the index has if nothing is configured. Sources are few."""
    rows = configured.filter("enabled").select("source") if configured.limit(1).count() else files.select("source").filter("source <> ''").distinct()
    return sorted(r["source"] for r in rows.collect())


def optimize(df: DataFrame, k: int, group: str, folder: str | None = None, tags: list[str] = (), start=None, end=None, lam: float = 0.7) -> DataFrame:
    """A result list (id, score, content, path, tags, modified) filtered, lowered by the counts of its groups, made diverse, and cut to k."""
    rows = df if folder is None else df.filter(F.col("path").startswith(folder))
    rows = rows.filter(tags_filter(F.col("tags"), list(tags))) if tags else rows
    rows = rows.filter(date_filter(F.col("modified"), start, end)) if start is not None or end is not None else rows
    listed = debias_by_mean(rows, group).select(F.lit(0).cast("long").alias("query_id"), "id", "score", "content")
    return mmr(listed, k, lam).drop("query_id")


def tags_filter(tags: Column, wanted: list[str]) -> Column:
    """Whether any wanted tag is among the tags, ignoring case; all rows pass if none is wanted."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.filter(F.transform(tags, F.lower), lambda t: t.isNotNull()), F.array(*(F.lower(F.lit(t)) for t in wanted))), F.lit(False))


def date_filter(modified: Column, start=None, end=None) -> Column:
    """Whether a time is within inclusive bounds, of which None is open; null times are not."""
    inside = modified.isNotNull()
    if start is not None:
        inside = inside & (modified >= F.lit(start))
    if end is not None:
        inside = inside & (modified <= F.lit(end))
    return inside


def folder_filter(path: Column, folder: str, standard: bool = True) -> Column:
    """standard: the folder itself or what is in it, ignoring case; else separators are normalised too and it must be inside."""
    f = folder.rstrip("/").lower() if standard else folder.replace("\\", "/").strip("/").lower()
    p = F.lower(path) if standard else F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "^/+", ""))
    inside = p.startswith(f + "/")
    return inside | (p == f) if standard else inside


def debias(df: DataFrame, group: str) -> DataFrame:
    """Scores lowered by how many results their file has: score / (1 + 0.1 ln n)."""
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("score", F.col("score") / (1 + 0.1 * F.log(n.cast("double"))))


def debias_by_mean(df: DataFrame, group: str) -> DataFrame:
    """Scores lowered by the group's count over the mean count: score * (1 - 0.1 log10(ratio + 1)).

    Counts are aggregated, so their mean needs no window over all rows.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    mean = F.broadcast(counts.agg(F.avg("_n").alias("_mean")))
    rows = df.join(counts, group).join(mean)
    return rows.withColumn("score", F.col("score") * (1 - 0.1 * F.log10(F.col("_n") / F.col("_mean") + 1))).drop("_n", "_mean")


def token_budget(df: DataFrame, budget: int, *order: Column, tokens: str = "tokens") -> DataFrame:
    """Rows in order until the budget would be exceeded. For result lists, which are a top-k."""
    running = F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("used", running).filter(F.col("used") <= budget)


def rerank(df: DataFrame, score: Column, top_n: int, factor: int = 3, threshold: float = 0.0, most: int = 50) -> DataFrame:
    """The best of the list by another score: at most `most` candidates (top_n at least), threshold only when positive."""
    candidates = min(max(top_n * max(2, factor), top_n), max(most, top_n))
    rows = df.orderBy(F.desc("score"), "id").limit(candidates).withColumn("recall_score", F.col("score")).withColumn("score", score)
    rows = rows.filter(F.col("score") >= threshold) if threshold > 0 else rows
    return rows.orderBy(F.desc("score"), "id").limit(top_n)


def mmr(df: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Greedy diversity on result lists (query_id, id, score, content) by bigram multisets; a list is one task's work, of at most some hundred rows."""

    def greedy(pdf):
        from collections import Counter

        rows = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        if len(rows) > k and k > 1:
            grams = [Counter(zip(t, t[1:], strict=False)) for t in ("".join(str(c or "").split()) for c in rows["content"])]

            def jaccard(a, b):
                if not a or not b:
                    return 0.0
                common = sum((a & b).values())
                return common / (sum(a.values()) + sum(b.values()) - common)

            left, chosen = list(range(1, len(rows))), [0]
            nearest = {i: jaccard(grams[i], grams[0]) for i in left}
            while len(chosen) < k and left:
                best = max(left, key=lambda i: (lam * rows["score"][i] - (1 - lam) * nearest[i], -i))
                chosen.append(best)
                left.remove(best)
                for i in left:
                    nearest[i] = max(nearest[i], jaccard(grams[i], grams[best]))
            rows = rows.iloc[chosen]
        else:
            rows = rows.head(k)
        return rows.assign(rank=range(1, len(rows) + 1))[["query_id", "id", "score", "rank"]]

    return df.groupBy("query_id").applyInPandas(greedy, "query_id long, id long, score double, rank long")


def merge_tiers(chunks: DataFrame, documents: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """Chunks (id, file_id, heading, score) lifted by their document's and sections' hits.

    Each hit of the file folds in as s <- 0.4 s + 0.3 doc, in order of its rank; each section whose path begins the chunk's
    adds 0.3 of its score.
    """
    docs = documents.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").alias("s")))).alias("docs"))
    rows = chunks.join(docs, "file_id", "left")
    folded = F.aggregate(F.coalesce("docs", F.expr("cast(array() as array<struct<rank:bigint,s:double>>)")), F.col("score"), lambda a, d: 0.4 * a + 0.3 * d["s"])
    rows = rows.withColumn("score", folded).drop("docs")
    inside = sections.select(F.col("file_id").alias("f"), F.col("heading").alias("h"), F.col("score").alias("s"))
    met = rows.join(inside, (F.col("file_id") == F.col("f")) & F.col("heading").startswith(F.col("h")), "left")
    lifted = met.groupBy("id", "file_id", "heading", "score").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("more"))
    return lifted.select("id", "file_id", "heading", (F.col("score") + 0.3 * F.col("more")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
