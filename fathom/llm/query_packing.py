"""Query op8: all documents in sequences of 2048 tokens."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import packing
from fathom.sources.tables import table

NAME = "op8_packing"
ORACLE = ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
