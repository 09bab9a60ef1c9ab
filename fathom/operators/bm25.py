"""BM25 over postings: an index as two tables, and top-k search by one join on the query's terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import text as X


def postings(docs: DataFrame, id_col: str, text_col: str, mode: str = "classic") -> DataFrame:
    """(id, term, tf, len): term frequencies; len is the number of the document's terms."""
    terms = X.tokens(F.col(text_col)) if mode == "classic" else X.fts_tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), terms.alias("terms"))
    return rows.select("id", F.size("terms").cast("long").alias("len"), F.explode("terms").alias("term")).groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def corpus(docs: DataFrame, id_col: str, text_col: str, mode: str = "classic") -> DataFrame:
    """One row: n documents and their mean length in terms."""
    terms = X.tokens(F.col(text_col)) if mode == "classic" else X.fts_tokens(F.col(text_col))
    return docs.select(F.size(terms).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def query_terms(spark, query: str, mode: str = "classic") -> list[str]:
    """The query's terms; distinct in classic mode, with repeats in full-text mode, where a repeat scores again."""
    row = spark.range(1).select((X.tokens(F.lit(query)) if mode == "classic" else X.fts_tokens(F.lit(query))).alias("t")).first()
    return list(dict.fromkeys(row["t"])) if mode == "classic" else row["t"]


def idf(n: Column, df: Column, mode: str) -> Column:
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log(odds + 1) if mode == "classic" else F.when(F.log(odds) <= 0, 1e-6).otherwise(F.log(odds))


def search(docs: DataFrame, id_col: str, text_col: str, query: str, k: int | None = 10, mode: str = "classic", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score, rank) of the k best documents; ties by id. k=None returns all with a positive score.

    classic: k1 and b as given. fts: the constants 1.2 and 0.75 are fixed, and b weights the term frequency.
    One scan: only postings of the query's terms leave it, so nothing of the corpus is shuffled but matches.
    """
    wanted = query_terms(docs.sparkSession, query, mode)
    terms = X.tokens(F.col(text_col)) if mode == "classic" else X.fts_tokens(F.col(text_col))
    count = lambda t: F.size(F.filter("terms", lambda x: x == t)).cast("double")
    distinct = list(dict.fromkeys(wanted))
    tf = F.array(*(count(F.lit(t)) for t in distinct)) if distinct else F.array().cast("array<double>")
    sized = lambda df: df.select(F.col(id_col).alias("id"), terms.alias("terms")).select("id", F.size("terms").cast("double").alias("len"), tf.alias("tf"))
    stats = sized(docs).agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.get("tf", F.lit(i)) > 0).cast("double")).alias(f"df{i}") for i in range(len(distinct))))
    # a term of classic mode stands in the lower-case text as it is: other texts need no tokens here
    holders = docs
    if mode == "classic" and distinct:
        holders = docs.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(text_col), F.lit(t)) for t in distinct)))
    scored = sized(holders).filter(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        times = 1 if mode == "classic" else wanted.count(t)
        f = F.get("tf", F.lit(i)) * (1.0 if mode == "classic" else b)
        a, c = (k1, b) if mode == "classic" else (1.2, 0.75)
        part = idf(F.col("n"), F.col(f"df{i}"), mode) * f * (a + 1) / (f + a * (1 - c + c * F.col("len") / F.col("avg_len")))
        score = score + times * F.when(f > 0, part).otherwise(0.0)
    ranked = scored.select("id", score.alias("score")).filter("score > 0")
    if k is None:
        return ranked
    top = ranked.orderBy(F.desc("score"), "id").limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def search_many(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) for rows (query_id, text) over a stored index of postings: joins and one window per query."""
    from pyspark.sql import Window

    asked = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    held = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    hits = held.join(asked, "term").join(df, "term").join(F.broadcast(stats))
    part = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # rounded, so that copies tie whatever the order of the sum
    scores = hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


#: Folders that the terms of a stored index are dealt to.
BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str, text_col: str, mode: str = "classic", buckets: int = BUCKETS) -> None:
    """Stores postings by bucket of their terms, sorted, so that a search reads only the row groups of its terms; and the lengths of documents."""
    made = postings(docs, id_col, text_col, mode).withColumn("bucket", bucket(F.col("term"), buckets))
    made.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = X.tokens(F.col(text_col)) if mode == "classic" else X.fts_tokens(F.col(text_col))
    docs.select(F.col(id_col).alias("id"), F.size(terms).cast("long").alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")


def search_index(spark, path: str, query: str, k: int = 10, k1: float = 1.5, b: float = 0.75, buckets: int = BUCKETS) -> DataFrame:
    """(id, score, rank) like `search` in classic mode, from a stored index: of the postings only the buckets and terms of the query are read."""
    from pyspark.sql import Window

    wanted = query_terms(spark, query)
    numbers = sorted({r["b"] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t"), buckets).alias("b")).collect()}) if wanted else []
    held = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*numbers) & F.col("term").isin(*wanted))
    sizes = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rows = held.join(F.broadcast(df), "term").join(F.broadcast(sizes))  # a row a term of the query, and one row
    part = idf(F.col("n"), F.col("df"), "classic") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scores = rows.groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))
    top = scores.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def stats(docs: DataFrame, text_col: str, mode: str = "classic") -> DataFrame:
    """Documents, mean characters of the tokenised content, vocabulary and terms."""
    terms = X.tokens(F.col(text_col)) if mode == "classic" else X.fts_tokens(F.col(text_col))
    rows = docs.select(terms.alias("terms"))
    sizes = rows.agg(F.count("*").alias("n_docs"), F.avg(F.length(F.array_join("terms", " "))).alias("avg_chars"), F.sum(F.size("terms")).cast("long").alias("n_terms"))
    words = rows.select(F.explode("terms").alias("t")).agg(F.count_distinct("t").alias("vocabulary"))
    return sizes.join(F.broadcast(words))
