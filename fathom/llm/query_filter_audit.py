"""Query op13: how five filters of all documents work together, under all 120 orders."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import filter_audit
from fathom.sources.tables import table

NAME = "op13_filter_audit"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT part, quality, toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS s,
         doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM d LEFT JOIN labels USING (doc_id)
), sets AS (
  SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN s THEN 'D' END, CASE WHEN e THEN 'E' END) AS failed,
         count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS f, failed, n, good, toxic,
         least(CASE WHEN contains(failed, 'A') THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN contains(failed, 'B') THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN contains(failed, 'C') THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN contains(failed, 'D') THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN contains(failed, 'E') THEN instr(filter_order, 'E') ELSE 6 END) AS falls
  FROM sets, orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN falls > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN falls = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN contains(failed, f) AND falls < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN falls = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN falls = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    marks = labels.selectExpr("doc_id", "quality AS good", "toxic")
    return filter_audit.audit(filter_audit.failures(docs, "lang", marks), "part", filter_audit.FILTERS, ["good", "toxic"]).drop("filter")
