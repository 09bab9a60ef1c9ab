"""Statistics of the index, of queries and of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.sources.tables import if_small


def query_summary(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row over the last days of (ts, duration_ms, results); 0 where there is none."""
    recent = log.filter(F.col("ts") >= as_of - F.make_interval(days=F.lit(days)))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).cast("double").alias(name)
    return recent.agg(F.count("*").alias("n"), zero(F.avg("duration_ms"), "avg_ms"), zero(F.max("duration_ms"), "max_ms"), zero(F.min("duration_ms"), "min_ms"), zero(F.avg("results"), "avg_results"))


def recent(log: DataFrame, n: int = 100, *ties: str) -> DataFrame:
    return log.orderBy(F.desc("ts"), *ties).limit(n)


def index_metrics(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("length").cast("long").alias("total_length"), F.sum("chunks").cast("long").alias("n_chunks"), F.sum("tokens").cast("long").alias("n_tokens"), F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"))


def source_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("chunks").cast("long").alias("n_chunks"), F.max("modified").alias("last_modified"))


def file_summary(results: DataFrame) -> DataFrame:
    """(file_id, path, n, best): result lists by file, at the place of the best hit."""
    return results.groupBy("file_id").agg(F.min_by("path", "rank").alias("path"), F.count("*").alias("n"), F.min("rank").alias("best"))


def extension_histogram(files: DataFrame, extension: Column) -> DataFrame:
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("n"))


def folders(files: DataFrame, folder: Column) -> DataFrame:
    return files.groupBy("source").agg(F.sort_array(F.collect_set(folder)).alias("folders"))


def percentile(column: str, p: float) -> Column:
    """Nearest rank, exact."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def percentiles(rows: DataFrame, group: list[str], value: str, wanted: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """(group, names of wanted): exact percentiles by nearest rank, without all values of a group in one task.

    A mergeable sketch of each group bounds where a percentile lies, to 2 / accuracy of the ranks on both sides. A second pass counts
    the values below, and the values inside one by one. If a sketch should have missed, which is seen from the counts, all of
    the group's values are counted. Null values are left out; a group without others has nulls. Groups may be null.
    """
    names, ps = list(wanted), [wanted[x] for x in wanted]
    edge = lambda d: F.array(*(F.lit(float(min(1, max(0, p + d)))) for p in ps))
    held = rows.select(F.struct(*group).alias("g"), F.col(value).alias("v"))
    sketch = lambda d: F.percentile_approx("v", edge(d), accuracy)
    bounds = held.groupBy("g").agg(F.count("v").alias("n"), sketch(-2 / accuracy).alias("low"), sketch(2 / accuracy).alias("high"))
    each = bounds.select("g", "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("n") * p)).alias("rank"), F.get("low", F.lit(i)).alias("low"), F.get("high", F.lit(i)).alias("high")) for i, p in enumerate(ps)))).alias("x")).select("g", "n", "x.*")

    def picked(asked: DataFrame) -> DataFrame:
        met = held.filter("v is not null").join(if_small(asked), "g").filter("v <= high or high is null")
        counted = met.groupBy("g", "i", "rank", F.when((F.col("v") >= F.col("low")) | F.col("low").isNull(), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
        through = counted.withColumn("through", F.sum("n").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("v"))))
        return through.filter("through >= rank").groupBy("g", "i").agg(F.min(F.struct("through", "v"))["v"].alias("v"))

    found = picked(each).filter("v is not null")
    missed = each.filter("n > 0").join(found, ["g", "i"], "left_anti").withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    whole = found.unionByName(picked(missed))
    made = bounds.select("g").join(whole, "g", "left").groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(x) for i, x in enumerate(names)))
    return made.select("g.*", *names)


def latency_summary(runs: DataFrame, group: list[str]) -> DataFrame:
    """Counts of success and failure, and latencies of the successes, per group of (ok, ms)."""
    ms = "CASE WHEN ok THEN ms END"
    counted = runs.groupBy(*group).agg(
        F.sum(F.col("ok").cast("long")).alias("n_ok"),
        F.sum((~F.col("ok")).cast("long")).alias("n_failed"),
        F.avg(F.expr(ms)).alias("avg_ms"),
        F.min(F.expr(ms)).alias("min_ms"),
        F.max(F.expr(ms)).alias("max_ms"),
    )
    ranked = percentiles(runs.withColumn("_ms", F.expr(ms)), group, "_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    ranked = ranked.withColumnsRenamed({g: f"{g}_" for g in group})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group))
    return counted.join(ranked, same).drop(*(f"{g}_" for g in group))


def first_errors(runs: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n failed runs (ok, error, ..), as a summary names them."""
    return runs.filter(~F.col("ok")).orderBy(*order).limit(n)


def bounded_stats(samples: DataFrame, key: str, order: list[str], value: str, n: int = 1000) -> DataFrame:
    """Per key the statistics of its last n samples."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    kept = samples.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    return kept.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *(percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))


def counters(events: DataFrame, key: str) -> DataFrame:
    """Counters and gauges: events of each key, and the last value."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


#: (rule, metric, whether over or under, limit, level)
ALERT_RULES = (("latency", "p95_ms", "over", 100.0, "warning"), ("memory", "memory_mb", "over", 2048.0, "warning"), ("results", "avg_results", "under", 3.0, "info"))


def check_alerts(metrics: DataFrame, rules=ALERT_RULES) -> DataFrame:
    """(rule, level, value) of each rule that a row of metrics breaks, strictly."""
    one = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[4]).alias("level"), F.col(r[1]).cast("double").alias("value"), (F.col(r[1]) > r[3] if r[2] == "over" else F.col(r[1]) < r[3]).alias("broken"))
    return metrics.select(F.explode(F.array(*(one(r) for r in rules))).alias("x")).filter("x.broken").select("x.rule", "x.level", "x.value")


def health(alerts: DataFrame) -> DataFrame:
    worst = alerts.agg(F.coalesce(F.max(F.when(F.col("level") == "critical", 2).when(F.col("level") == "warning", 1).otherwise(0)), F.lit(0)).alias("w"))
    return worst.select(F.when(F.col("w") == 2, "unhealthy").when(F.col("w") == 1, "degraded").otherwise("healthy").alias("status"))
