"""Records of tests, sources, models and requests: filters, pages, overviews and reports of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def matching(records: DataFrame, **equal) -> DataFrame:
    """Records whose columns equal the values given; None leaves a column open."""
    for name, value in equal.items():
        records = records if value is None else records.filter(F.col(name) == value)
    return records


def newest(records: DataFrame, time: str, n: int, *ties: str) -> DataFrame:
    return records.orderBy(F.desc(time), *ties).limit(n)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """The page of that number, from 1, of `size` rows; a number or size below 1 counts as 1."""
    number, size = max(1, number), max(1, size)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(keys: list[str], cursor: Sequence) -> Column:
    """Whether a row comes after the cursor, the values of its keys in a row seen before, in their order."""
    holds, equal = F.lit(False), F.lit(True)
    for name, value in zip(keys, cursor, strict=True):
        holds = holds | (equal & (F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    # said once more of the first key alone, so that readers skip what lies before
    return (F.col(keys[0]) >= F.lit(cursor[0])) & holds


def keyset_page(rows: DataFrame, keys: list[str], size: int, cursor: Sequence | None = None) -> DataFrame:
    """The next `size` rows by ascending keys after the cursor, from the start without one.

    Keys together name a row and are not null. A page costs the same wherever it lies, and rows that come in before the
    cursor move no other row from one page to the next.
    """
    return (rows if cursor is None else rows.filter(after(keys, cursor))).orderBy(*keys).limit(size)


def write_ordered(rows: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Stores rows by ranges of their keys, so that a page reads only the files and row groups around its cursor."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def scan(read: Callable[[], DataFrame], keys: list[str], size: int, cursor: Sequence | None = None) -> Iterator[tuple[list, tuple]]:
    """Pages (rows, cursor) of what read() gives, one after another; a reader that stopped goes on from its last cursor."""
    while found := keyset_page(read(), keys, size, cursor).collect():
        cursor = tuple(found[-1][k] for k in keys)
        yield found, cursor


def file_list(files: DataFrame, source: str | None, n: int, *order: Column | str) -> DataFrame:
    """At most n files, of one source if it is given, whose name is compared without case."""
    rows = files if source is None else files.filter(F.lower("source") == source.lower())
    return rows.orderBy(*order).limit(n)


def allowed_path(path: Column, roots: list[str]) -> Column:
    """Whether a path has no part `..` and lies below one of the roots, whatever the case and the separators."""
    plain = F.lower(F.translate(path, "\\", "/"))
    inside = F.lit(False)
    for root in roots:
        base = root.replace("\\", "/").rstrip("/").lower()
        inside = inside | (plain == base) | plain.startswith(base + "/")
    return F.coalesce(inside & ~F.array_contains(F.split(plain, "/"), ".."), F.lit(False))


def allowed_range(start: Column, end: Column, most: int | None = None) -> Column:
    """Whether two line numbers are a range: not below 1, in order, and at most `most` lines."""
    holds = (start >= 1) & (end >= start)
    return F.coalesce(holds if most is None else holds & (end - start < most), F.lit(False))


def loose_double(value: Column) -> Column:
    """A number, or a string that is one; 0 for everything else."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def string_list(text: Column) -> Column:
    """The strings of a JSON list; empty for null or what is no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def string_map(text: Column) -> Column:
    """The values of a JSON object as strings; empty for null or what is no object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def test_statistics(records: DataFrame, group: str, keys: list[str] = ()) -> DataFrame:
    """Records (group, passed, results: map) per group: their number, how many passed, and the mean of each key over the records that have it, else 0."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.map_contains_key("results", k), loose_double(F.col("results")[k]))), F.lit(0.0))
    return records.groupBy(group).agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), *(mean(k).alias(f"avg_{k}") for k in keys))


def category_statistics(records: DataFrame, category: str = "category") -> DataFrame:
    """Per category the number of records, how many passed, and the sum of their deviations."""
    return records.groupBy(category).agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), F.sum(F.abs(F.col("score") - F.col("expected"))).alias("deviation"))


def evaluation_report(runs: DataFrame, measures: list[str]) -> DataFrame:
    """One row over runs (ok, measures ..): their number, the successes, and the mean of each measure over these, else 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("ok"), F.col(c))), F.lit(0.0)).alias(f"avg_{c}")
    return runs.agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), *(mean(c) for c in measures))


def keyword_recall(n_relevant: Column, n_keywords: Column, n_returned: Column) -> Column:
    """Relevant results over the lesser of expected keywords and results; several results of one keyword may take it over 1."""
    least = F.least(n_keywords, n_returned)
    return F.when(least > 0, n_relevant / least).otherwise(0.0)


def source_overview(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Every configured source (source, enabled) with the files, chunks and last change that the index has of it; sources are a few rows."""
    from fathom.operators.stats import source_rollup

    found = sources.join(source_rollup(files), "source", "left")
    return found.select("source", "enabled", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "last_modified")


def dashboard(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: configured sources, and the files, chunks and tokens of these alone."""
    mine = files.join(F.broadcast(sources.select("source").distinct()), "source", "left_semi")
    totals = mine.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    return totals.join(F.broadcast(sources.agg(F.count_distinct("source").alias("n_sources"))))


def model_overview(stats: DataFrame, downloaded: DataFrame, current: str | None = None) -> DataFrame:
    """Statistics of stored vectors by model, whether the model is there, and an empty row for the current model if it has none yet."""
    if current is not None:
        empty = stats.sparkSession.createDataFrame([(current,)], "model string").join(stats.select("model"), "model", "left_anti")
        stats = stats.unionByName(empty, allowMissingColumns=True)
    there = downloaded.select("model").distinct().withColumn("exists", F.lit(True))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_vectors", "dimension", "bytes")]
    return stats.join(there, "model", "left").select("model", *numbers, F.coalesce("exists", F.lit(False)).alias("exists"))


def default_model(registered: DataFrame, order: str) -> DataFrame:
    """The model that was registered first."""
    return registered.orderBy(order, "model").limit(1)


def by_position(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (rank, from 1) with the scores (position, from 0; score) that a reranker gave them by their place; what got none goes."""
    return candidates.join(scores.select((F.col("position") + 1).alias("rank"), F.col("score").alias("rerank_score")), "rank")


def rerank_statistics(reranked: DataFrame) -> DataFrame:
    """One row: how many rows were reranked, and their mean score, else 0."""
    return reranked.agg(F.count("*").alias("n"), F.coalesce(F.avg("rerank_score"), F.lit(0.0)).alias("avg_score"))


def active(last: Column, now: Column, minutes: int = 5) -> Column:
    """Whether the last event is less than some minutes ago."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) < minutes * 60_000_000, F.lit(False))


def token_counters(events: DataFrame) -> DataFrame:
    """Tokens of each operation (op, tokens, ts): calls, total, and when it was last."""
    return events.groupBy("op").agg(F.count("*").alias("calls"), F.sum("tokens").cast("long").alias("tokens"), F.max("ts").alias("last"))


def throughput(runs: DataFrame) -> DataFrame:
    """Per batch size of runs (batch, chars, tokens, ms) what a second does; 0 for no time."""
    second = F.sum("ms") / 1000
    rate = lambda c: F.when(second > 0, c / second).otherwise(0.0)
    return runs.groupBy("batch").agg(F.count("*").alias("n"), rate(F.sum("chars")).alias("chars_per_s"), rate(F.sum("tokens")).alias("tokens_per_s"), rate(F.count("*")).alias("runs_per_s"))
