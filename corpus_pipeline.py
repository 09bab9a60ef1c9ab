"""From raw documents to packed training sequences, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs has the columns of `documents` and
stands in a written table, and returns a DataFrame. All but the last return the columns of docs, whatever further ones
there are. Null texts are as empty ones, null doc_ids are kept as they come, rows that repeat are kept but for those of the
n-gram join, and without documents every stage gives an empty table; the operators' modules say what holds in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from fathom.llm.storage import by_ids, save, scratch
from fathom.sources.tables import table

WIDTH, NUM, DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; the verdict depends on the text alone, so copies go together."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    toxic = save(scored.filter("predicted = 1").select(F.col("th").alias("_th")).distinct(), "toxic")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    return by_ids(rows, toxic, "_th", "left_anti").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that repeat an earlier document go; so do documents of which no word stays."""
    counted = "_removed" + "_" * max(map(len, docs.columns))  # no column has this name
    kept = line_dedup.dedup(docs, counted)
    return kept.filter((F.col(counted) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; of rows that repeat a doc_id, one does."""
    with scratch() as keep:
        joined = save(ngram_join.join(docs, WIDTH, NUM, DEN), "joined")
        keep(joined)
    later = save(joined.filter("component_id <> doc_id").select("doc_id").distinct(), "later")
    repeated = save(joined.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    kept = by_ids(docs, later, "doc_id", "left_anti")
    return by_ids(kept, repeated, "doc_id", "left_anti").unionByName(by_ids(kept, repeated, "doc_id").dropDuplicates(["doc_id"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that mostly are such passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, a row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: Several stages (dictionary training, patience alignment, packing) are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
