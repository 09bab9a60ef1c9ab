"""Scans of text folders through Spark's file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def matches(path: Column, patterns: list[str]) -> Column:
    """Any of: `*.ext`, a suffix ignoring case; else a part of the path."""
    one = lambda p: F.lower(path).endswith(p[1:].lower()) if p.startswith("*.") else F.contains(path, F.lit(p))
    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(not patterns))


def excluded(name: Column, rules: list[str]) -> Column:
    """Any of: `*x` suffix, `x*` prefix, `~x` prefix, else the whole name."""
    one = lambda r: name.endswith(r[1:]) if r.startswith("*") else name.startswith(r[:-1]) if r.endswith("*") else name.startswith(r) if r.startswith("~") else name == r
    return reduce(lambda a, b: a | b, map(one, rules), F.lit(False))


def scan(spark: SparkSession, roots: list[str], patterns: list[str] = ("*.md", "*.txt"), exclude_dirs: list[str] = (), exclude_files: list[str] = (), recursive: bool = True, modified_after: str | None = None) -> DataFrame:
    """(path, length, mtime, content) of files under the roots, each once; content is binary and read only where it is used."""
    # a root below another one would give its files twice; dropping it here needs no shuffle
    roots = sorted({r.rstrip("/") for r in roots})
    if recursive:
        roots = [r for r in roots if not any(r.startswith(o + "/") for o in roots)]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    files = reader.load(list(roots)).withColumnRenamed("modificationTime", "mtime")
    kept = files.filter(matches(F.col("path"), list(patterns)))
    for d in exclude_dirs:
        kept = kept.filter(~F.contains(F.col("path"), F.lit(d)))
    name = F.substring_index("path", "/", -1)
    return kept.filter(~excluded(name, list(exclude_files)))


def texts(files: DataFrame) -> DataFrame:
    """Files with text, their content as UTF-8."""
    return files.withColumn("text", F.decode("content", "UTF-8")).drop("content")


def report(files: DataFrame) -> DataFrame:
    """(extension, n, bytes) of a scan."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def listing(files: DataFrame, n: int = 100) -> DataFrame:
    """The first n files of a scan by path, as a source's page shows them."""
    return files.orderBy("path").limit(n)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_queries(log: DataFrame, path: str) -> None:
    """Appends (query, ..) with its hash to a Parquet log."""
    log.withColumn("query_hash", F.upper(F.substring(F.sha2("query", 256), 1, 16))).write.mode("append").parquet(path)


def safe_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of the paths given: null text for files that are gone or cannot be read; Spark tries a task again before that."""
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return wanted.withColumn("text", F.lit(None).cast("string"))
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(there)
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    found = texts(read).select(plain(F.col("path")).alias("key"), "text")
    return wanted.withColumn("key", plain(F.col("path"))).join(found, "key", "left").select("path", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def append_records(records: DataFrame, path: str) -> None:
    """Appends test records to a Parquet table."""
    records.write.mode("append").parquet(path)


def clear_records(spark: SparkSession, path: str, to: str, **equal) -> None:
    """Writes the records of `path` but for those that equal all the values given (all of them without any) to `to`."""
    rows = spark.read.parquet(path)
    gone = F.lit(True)
    for name, value in equal.items():
        gone = gone & F.col(name).eqNullSafe(F.lit(value))
    rows.filter(~gone).write.mode("overwrite").parquet(to)


def append_token_log(metrics: DataFrame, path: str) -> None:
    """Appends rows (ts, op, model, tokens) as lines with bars between the columns; also as a writer of micro-batches."""
    metrics.select("ts", "op", "model", "tokens").write.mode("append").option("sep", "|").csv(path)
