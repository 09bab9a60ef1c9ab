"""Query op11: the periodic runs of all documents, some of which are made periodic first."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm import periodic_runs as p
from fathom.llm.text_stats import words
from fathom.sources.tables import table

NAME = "op11_periodic_runs"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the greatest run, and digests of all runs and of the text without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(p.runs(planted(docs)))


def planted(docs: DataFrame) -> DataFrame:
    """Of documents whose crc32 of doc_id is divisible by 10, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.when(h % 10 == 0, F.size(words(F.col("text"))).cast("long"))
    chosen = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10").alias("g"), n.alias("n"))
    chosen = chosen.withColumn("start", F.expr("CASE WHEN n > 0 THEN g % n END"))
    period = F.expr("1 + (n - start) div (3 + g % 8)")
    return chosen.select("doc_id", F.when(F.col("start").isNotNull(), p.repeated_from(F.col("text"), F.col("start"), period)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Rows (doc_id, text, runs) to the digest columns."""
    runs = F.col("runs")
    lines = F.transform(runs, lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    joined = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("best")
    return found.withColumn("best", p.greatest(runs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *(best[k].alias(k) for k in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(joined, 256).alias("runs_sha256"),
        F.sha2(F.coalesce(p.collapsed(F.col("text"), runs), F.lit("")), 256).alias("collapsed_sha256"),
    )
