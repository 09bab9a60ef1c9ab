"""Query op12: the tokens of every document."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm import token_counts
from fathom.sources.tables import table

NAME = "op12_token_counts"
ORACLE = ""
LIMIT = 1024


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new, so that every distinct text is encoded; a caller who keeps one passes it to token_counts.count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count(docs, token_counts.own_cache(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
