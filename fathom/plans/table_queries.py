"""Queries of changing tables, statistics, evaluation and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.operators import evaluation, stats, sync
from fathom.sources.tables import table
from fathom.streaming import changes

AS_OF = "2024-01-15 00:00:00"


def stored_and_disk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored state and a later one of the same files: some gone, some new, some with other text, some moved."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.upper(F.sha2("text", 256)).alias("hash"))
    stored = d.filter("doc_id % 11 <> 0").select("path", "hash")
    new_hash = F.when(F.col("doc_id") % 7 == 0, F.upper(F.sha2("hash", 256))).otherwise(F.lower("hash"))
    path = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return stored, d.filter("doc_id % 13 <> 0").select(path.alias("path"), new_hash.alias("hash"))


DISK_SQL = """d AS (SELECT doc_id, 'f' || doc_id AS path, upper(sha256(text)) AS hash FROM documents),
stored AS (SELECT path, hash FROM d WHERE doc_id % 11 <> 0),
disk AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 7 = 0 THEN upper(sha256(hash)) ELSE lower(hash) END AS hash FROM d WHERE doc_id % 13 <> 0)"""


def classify_changes(spark, sf_dir):
    return sync.classify_changes(*stored_and_disk(spark, sf_dir))


def detect_moves(spark, sf_dir):
    stored, disk = stored_and_disk(spark, sf_dir)
    return sync.detect_moves(stored, disk.withColumn("hash", F.upper("hash")))


def find_duplicates(spark, sf_dir):
    return sync.find_duplicates(stored_and_disk(spark, sf_dir)[0])


def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("new").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return sync.upsert(old, rows, ["c_custkey"], "o_orderkey")


def changed_by_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    stored = e.filter("n % 5 <> 0").select("path", F.when(F.col("n") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("indexed_at"))
    return sync.changed_by_time(stored, e.filter("n % 7 <> 0").select("path", F.col("b").alias("mtime")))


def cascade_delete(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("source"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"))
    left = sync.delete_source(files, chunks, chunks.select("chunk_id"), "1-URGENT")
    return chunks.join(left[2], "chunk_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("n"))


def owner_source(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/v/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    sources = spark.sql("SELECT * FROM VALUES ('all', '/v/'), ('s', '/v/s'), ('standard', '/v/standard') AS t(source, root)")
    return sync.owner_source(files, sources).groupBy("owner").agg(F.count("*").alias("n"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("mode"), F.col("value").alias("duration_ms"), (F.col("user_id") % 20).alias("results"))


def query_summary(spark, sf_dir):
    made = stats.query_summary(query_log(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), 7)
    return made.withColumns({c: F.round(c, 6) for c in made.columns if c != "n"})


def recent_queries(spark, sf_dir):
    return stats.recent(query_log(spark, sf_dir), 20, "event_id").select("event_id", "mode")


def latency_summary(spark, sf_dir):
    runs = query_log(spark, sf_dir).select("mode", (F.col("event_id") % 9 != 0).alias("ok"), F.col("duration_ms").alias("ms"))
    return stats.latency_summary(runs, ["mode"]).withColumn("avg_ms", F.round("avg_ms", 6))


def bounded_stats(spark, sf_dir):
    made = stats.bounded_stats(query_log(spark, sf_dir), "mode", ["ts", "event_id"], "duration_ms", 1000)
    return made.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


def counters(spark, sf_dir):
    return stats.counters(table(spark, sf_dir, "events"), "event_type")


def alerts(spark, sf_dir):
    log = query_log(spark, sf_dir)
    row = log.agg(stats.percentile("duration_ms", 0.95).alias("p95_ms"), F.lit(4096.0).alias("memory_mb"), F.lit(2.5).alias("avg_results"))
    return stats.check_alerts(row)


def index_metrics(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.length("text").alias("length"), F.size(F.split("text", "\n", -1)).alias("chunks"), F.size(F.split("text", " ", -1)).alias("tokens"), F.col("doc_id").alias("indexed_at"))
    return stats.index_metrics(f)


def source_rollup(spark, sf_dir):
    return stats.source_rollup(table(spark, sf_dir, "documents").select("source", F.size(F.split("text", "\n", -1)).alias("chunks"), F.col("doc_id").alias("modified")))


def file_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("path"), F.col("vec_id").alias("rank"))
    return stats.file_summary(e)


def folders(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("folder"))
    return stats.folders(p, F.col("folder")).select("source", F.array_join("folders", "|").alias("folders"))


def extension_histogram(spark, sf_dir):
    return stats.extension_histogram(table(spark, sf_dir, "pages"), F.lower(F.regexp_extract(F.substring_index("url", "/", -1), r"(\.[a-z0-9]+)$", 1)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists with judgments: vectors by label, quality as what is expected."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels"), F.col("vec_id") == F.col("doc_id"))
    score = F.get("embedding", F.lit(0)).cast("double")
    rows = rows.select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("id"), score.alias("score"), ((F.col("quality") + F.col("vec_id") % 3) / 3.0).alias("expected"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


JUDGED_SQL = "j AS (SELECT label::BIGINT AS query_id, vec_id AS id, embedding[1]::DOUBLE AS score, ((quality + vec_id % 3) / 3.0)::DOUBLE AS expected, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank, row_number() OVER (PARTITION BY label ORDER BY (quality + vec_id % 3) DESC, vec_id) AS ideal FROM embeddings JOIN labels ON vec_id = doc_id)"


def measure(spark, sf_dir):
    j = judged(spark, sf_dir)
    parts = [
        evaluation.ndcg(j).withColumnRenamed("ndcg", "ndcg"),
        evaluation.ndcg(j, 5).withColumnRenamed("ndcg", "ndcg_5"),
        evaluation.ndcg(j, exponential=True).withColumnRenamed("ndcg", "ndcg_exp"),
        evaluation.mrr(j),
        evaluation.mrr_top(j).withColumnRenamed("mrr", "mrr_top"),
        evaluation.average_precision(j),
        evaluation.errors(j, ["query_id"]),
        evaluation.ranking_accuracy(j),
        evaluation.ranking_accuracy(j, 1).withColumnRenamed("accuracy", "accuracy_1"),
        evaluation.spearman(j),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.join(p, "query_id")
    return made.withColumns({c: F.round(c, 6) for c in made.columns if c != "query_id"})


def precision_recall(spark, sf_dir):
    j = judged(spark, sf_dir)
    made = evaluation.precision_recall(j.filter("rank <= 5").select("query_id", "id"), j.filter("expected >= 0.5").select("query_id", "id"))
    return made.withColumns({c: F.round(c, 6) for c in made.columns if c != "query_id"})


def debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", F.col("event_type").alias("change"))
    return changes.debounce(e, "1 hour").drop("change")


def settled_changes(spark, sf_dir):
    """Events of users as changes; each purchase is a rename from the user whose number is half as great."""
    path = lambda c: F.concat(F.lit("u"), c.cast("string"))
    e = table(spark, sf_dir, "events").select(path(F.col("user_id")).alias("path"), "ts", F.col("event_type").alias("change"), F.when(F.col("event_type") == "purchase", path(F.floor(F.col("user_id") / 2))).alias("old_path"))
    return changes.settle(e, 3_600_000)


def window_counts(spark, sf_dir):
    made = changes.counts(table(spark, sf_dir, "events"), "1 hour", "1 hour")
    return made.withColumn("total", F.round("total", 4))


QUERIES = {f.__name__: f for f in (classify_changes, detect_moves, find_duplicates, upsert_rows, changed_by_time, cascade_delete, owner_source, query_summary, recent_queries, latency_summary, bounded_stats, counters, alerts, index_metrics, source_rollup, file_summary, folders, extension_histogram, measure, precision_recall, debounce, settled_changes, window_counts)}

P = lambda p: f"quantile_disc(ms, {p})"
ORACLES = {
    "classify_changes": f"WITH {DISK_SQL} SELECT path, CASE WHEN s.hash IS NULL THEN 'New' WHEN k.hash IS NULL THEN 'Deleted' WHEN upper(s.hash) = upper(k.hash) THEN 'Unchanged' ELSE 'Modified' END AS change FROM stored s FULL JOIN disk k USING (path)",
    "detect_moves": f"WITH {DISK_SQL}, g AS (SELECT hash, min(path) AS old FROM stored WHERE path NOT IN (SELECT path FROM disk) GROUP BY hash), c AS (SELECT upper(hash) AS hash, min(path) AS new FROM disk WHERE path NOT IN (SELECT path FROM stored) GROUP BY 1) SELECT old, new FROM g JOIN c USING (hash)",
    "find_duplicates": f"WITH {DISK_SQL} SELECT path, first FROM stored JOIN (SELECT hash, min(path) AS first FROM stored GROUP BY hash) USING (hash) WHERE path > first",
    "upsert_rows": "WITH n AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT o_custkey, 'new', p FROM n",
    "changed_by_time": "WITH e AS (SELECT 'u' || user_id AS path, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY 1), s AS (SELECT path, CASE WHEN n % 2 = 0 THEN b ELSE a END AS i FROM e WHERE n % 5 <> 0), k AS (SELECT path, b AS m FROM e WHERE n % 7 <> 0) SELECT path, CASE WHEN i IS NULL THEN 'New' WHEN m IS NULL THEN 'Deleted' WHEN m > i + INTERVAL 1 SECOND THEN 'Modified' ELSE 'Unchanged' END AS change FROM s FULL JOIN k USING (path)",
    "cascade_delete": "SELECT l_orderkey AS file_id, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "owner_source": "SELECT CASE WHEN starts_with(lower(p_type), 'standard') THEN 'standard' WHEN starts_with(lower(p_type), 's') THEN 's' ELSE 'all' END AS owner, count(*)::BIGINT AS n FROM part GROUP BY 1",
    "query_summary": f"SELECT count(*)::BIGINT AS n, round(coalesce(avg(value), 0), 6) AS avg_ms, round(coalesce(max(value), 0), 6) AS max_ms, round(coalesce(min(value), 0), 6) AS min_ms, round(coalesce(avg(user_id % 20), 0), 6) AS avg_results FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
    "recent_queries": "SELECT event_id, event_type AS mode FROM events ORDER BY ts DESC, event_id LIMIT 20",
    "latency_summary": f"WITH r AS (SELECT event_type AS mode, event_id % 9 <> 0 AS ok, CASE WHEN event_id % 9 <> 0 THEN value END AS ms FROM events) SELECT mode, sum(ok::INT)::BIGINT AS n_ok, sum((NOT ok)::INT)::BIGINT AS n_failed, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, {P(0.5)} AS p50, {P(0.95)} AS p95, {P(0.99)} AS p99 FROM r GROUP BY mode",
    "bounded_stats": f"WITH r AS (SELECT event_type AS mode, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT mode, count(*)::BIGINT AS n, round(sum(ms), 4) AS total, round(avg(ms), 6) AS mean, min(ms) AS least, max(ms) AS most, {P(0.5)} AS p50, {P(0.95)} AS p95, {P(0.99)} AS p99 FROM r WHERE r <= 1000 GROUP BY mode",
    "counters": "SELECT event_type, count(*)::BIGINT AS n, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type",
    "alerts": "WITH m AS (SELECT quantile_disc(value, 0.95) AS p FROM events) SELECT 'latency' AS rule, 'warning' AS level, p AS value FROM m WHERE p > 100 UNION ALL SELECT 'memory', 'warning', 4096.0 UNION ALL SELECT 'results', 'info', 2.5",
    "index_metrics": "SELECT count(*)::BIGINT AS n_files, sum(length(text))::BIGINT AS total_length, sum(len(string_split(text, chr(10))))::BIGINT AS n_chunks, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens, min(doc_id) AS first, max(doc_id) AS last FROM documents",
    "source_rollup": "SELECT source, count(*)::BIGINT AS n_files, sum(len(string_split(text, chr(10))))::BIGINT AS n_chunks, max(doc_id) AS last_modified FROM documents GROUP BY source",
    "file_summary": "SELECT label AS file_id, 'p' || min(vec_id) AS path, count(*)::BIGINT AS n, min(vec_id) AS best FROM embeddings GROUP BY label",
    "folders": "SELECT p_brand AS source, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS folders FROM part GROUP BY 1",
    "extension_histogram": "SELECT lower(regexp_extract(string_split(url, '/')[-1], '(\\.[a-z0-9]+)$', 1)) AS extension, count(*)::BIGINT AS n FROM pages GROUP BY 1",
    "measure": f"""WITH {JUDGED_SQL}, r AS (SELECT *, sum((expected >= 0.5)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM j)
SELECT query_id, round(sum(expected / log2(rank + 1)) / sum(expected / log2(ideal + 1)), 6) AS ndcg,
round(sum(CASE WHEN rank <= 5 THEN expected / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 5 THEN expected / log2(ideal + 1) ELSE 0 END), 6) AS ndcg_5,
round(sum((pow(2, expected) - 1) / log2(rank + 1)) / sum((pow(2, expected) - 1) / log2(ideal + 1)), 6) AS ndcg_exp,
round(coalesce(1.0::DOUBLE / min(rank) FILTER (expected >= 0.5), 0), 6) AS mrr,
round(1.0::DOUBLE / arg_max(rank, (expected, -rank)), 6) AS mrr_top,
round(coalesce(sum((expected >= 0.5)::INT * found::DOUBLE / rank) / nullif(sum((expected >= 0.5)::INT), 0), 0), 6) AS ap,
round(avg(abs(score - expected)), 6) AS mae, round(sqrt(avg((score - expected) * (score - expected))), 6) AS rmse, round(coalesce(corr(score, expected), 0), 6) AS pearson,
round(avg((rank = ideal)::INT), 6) AS accuracy, round(avg((abs(rank - ideal) <= 1)::INT), 6) AS accuracy_1,
round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum(pow(rank - ideal, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1)) ELSE 0 END, 6) AS rho
FROM r GROUP BY query_id""",
    "precision_recall": f"WITH {JUDGED_SQL}, s AS (SELECT query_id, avg((expected >= 0.5)::INT) FILTER (rank <= 5) AS p, sum((expected >= 0.5)::INT) FILTER (rank <= 5)::DOUBLE / nullif(sum((expected >= 0.5)::INT), 0) AS r FROM j GROUP BY query_id) SELECT query_id, round(p, 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(CASE WHEN p + coalesce(r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s",
    "settled_changes": """
WITH e AS (SELECT 'u' || user_id AS path, ts, event_type AS change, CASE WHEN event_type = 'purchase' THEN 'u' || (user_id // 2) END AS old_path FROM events),
b AS (SELECT * FROM e UNION ALL SELECT old_path, ts, NULL, NULL FROM e WHERE old_path IS NOT NULL),
l AS (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS before FROM b),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts) AS burst FROM l),
a AS (SELECT *, max(ts) FILTER (change IS NULL) OVER (PARTITION BY path, burst) AS away FROM s)
SELECT path, arg_max(change, (ts, change)) AS change, arg_max(old_path, (ts, old_path)) FILTER (old_path IS NOT NULL) AS old_path, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS n
FROM a WHERE change IS NOT NULL AND (away IS NULL OR ts > away) GROUP BY path, burst""",
    "debounce": "WITH o AS (SELECT 'u' || user_id AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT path, ts, sum(b) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT path, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS n FROM g GROUP BY path, g",
    "window_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
