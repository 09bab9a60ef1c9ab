"""Query op5: quality verdicts on all documents."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import quality_rules
from fathom.sources.tables import table

NAME = "op5_quality_rules"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
