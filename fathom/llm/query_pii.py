"""Query op3: personal data in all documents."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import pii
from fathom.sources.tables import table

NAME = "op3_pii"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))
