"""Query op2: all documents without common blocks of earlier ones."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm import line_dedup
from fathom.sources.tables import table

NAME = "op2_line_dedup"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    return line_dedup.dedup(docs, "n_removed").select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
