"""Query op10: a toxicity score for every document."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import toxicity
from fathom.sources.tables import table

NAME = "op10_toxicity"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).drop("th")
