"""Tables that change: upsert, deletion, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fathom.sources.tables import if_small


def newest(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last by `order`. Without an order, a key with two rows or more is an error."""
    held = rows.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"))
    if order is not None:
        last = Window.partitionBy("key").orderBy(F.desc(F.col("row")[order]))
        return held.withColumn("place", F.row_number().over(last)).filter("place = 1").select("row.*")
    counted = held.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    refused = F.raise_error(F.lit("a key has several new rows, and no order says which is the last"))
    return counted.filter(F.when(F.col("n") > 1, refused.cast("boolean")).otherwise(True)).select("row.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """existing with the rows of new in place of those of equal keys; of new rows with equal keys the last by `order` stays, without one they are refused."""
    new = newest(new, keys, order)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_files(files: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of gone (file_id), with their chunks and the chunks' vectors."""
    dropped = chunks.join(gone.select("file_id"), "file_id", "left_semi").select("chunk_id")
    return delete(files, gone, ["file_id"]), delete(chunks, gone, ["file_id"]), delete(vectors, dropped, ["chunk_id"])


def delete_source(files: DataFrame, chunks: DataFrame, vectors: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return delete_files(files, chunks, vectors, files.filter(F.col("source") == source).select("file_id"))


def drop_model(vectors: DataFrame, model: str) -> DataFrame:
    return vectors.filter(~F.col("model").eqNullSafe(model))


def drop_orphans(vectors: DataFrame, models: list[str]) -> DataFrame:
    return vectors.filter(F.col("model").isin(*models))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def vectors_for(vectors: DataFrame, ids: DataFrame, models: list[str]) -> DataFrame:
    """One vector for each wanted chunk, of the first model in the list that has one."""
    place = F.array_position(F.array(*(F.lit(m) for m in models)), F.col("model"))
    rows = vectors.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("_p", place).filter("_p > 0")
    first = Window.partitionBy("chunk_id").orderBy("_p")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_p")


def classify_changes(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change) of two tables (path, hash): New, Modified, Deleted or Unchanged."""
    both = stored.select("path", F.col("hash").alias("old")).join(disk.select("path", F.col("hash").alias("new")), "path", "full_outer")
    same = F.upper("old") == F.upper("new")
    change = F.when(F.col("old").isNull(), "New").when(F.col("new").isNull(), "Deleted").when(same, "Unchanged").otherwise("Modified")
    return both.select("path", change.alias("change"))


def changed_by_time(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change) by times: a file is modified when its mtime is over a second after it was indexed."""
    both = stored.select("path", "indexed_at").join(disk.select("path", "mtime"), "path", "full_outer")
    late = F.col("mtime") > F.col("indexed_at") + F.expr("INTERVAL 1 SECOND")
    return both.select("path", F.when(F.col("indexed_at").isNull(), "New").when(F.col("mtime").isNull(), "Deleted").when(late, "Modified").otherwise("Unchanged").alias("change"))


def find_duplicates(files: DataFrame) -> DataFrame:
    """(path, first): files whose content an earlier path has too."""
    first = files.groupBy("hash").agg(F.min("path").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return files.join(first, "hash").filter("path > first").select("path", "first")


def detect_moves(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(old, new): stored paths that are gone while a new path has their content; the least of several."""
    gone = stored.join(disk.select("path"), "path", "left_anti").groupBy("hash").agg(F.min("path").alias("old"))
    come = disk.join(stored.select("path"), "path", "left_anti").groupBy("hash").agg(F.min("path").alias("new"))
    return gone.join(come, "hash").select("old", "new")


def owner_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with the source of the longest path that begins theirs; sources (source, root) are a configuration, a few rows."""
    met = files.join(if_small(sources), files["path"].startswith(sources["root"]), "left")
    return met.groupBy(*files.columns).agg(F.max_by("source", F.length("root")).alias("owner"))


def orphans(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files under none of the configured roots."""
    return files.join(if_small(sources), files["path"].startswith(sources["root"]), "left_anti")
