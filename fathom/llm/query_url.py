"""Query op9: the verdict on every page's url."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import url_filter
from fathom.sources.tables import table

NAME = "op9_url_filter"

LAST = "array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
KNOWN = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)
TWO = LAST.format(n=2)
DOMAIN = f"CASE WHEN {TWO} IN ({KNOWN}) THEN {LAST.format(n=3)} ELSE {TWO} END"
SUFFIX = f"CASE WHEN {TWO} IN ({KNOWN}) THEN {TWO} ELSE list_extract(string_split(host, '.'), -1) END"

ORACLE = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), o AS (
  SELECT host, (rule IN ('example.org/en/1', 'example.org/es/', 'com/de/'))::INT AS blocked FROM r WHERE rule IS NOT NULL
), h AS (
  SELECT host, {DOMAIN} AS domain, {SUFFIX} AS suffix,
    sum(blocked)::DOUBLE AS k, count(*)::DOUBLE AS n
  FROM o GROUP BY host
), d AS (
  SELECT domain, suffix, sum(k) AS k, sum(n) AS n, avg(pow(k / n, 2)) - pow(avg(k / n), 2) AS v FROM h GROUP BY domain, suffix
), s AS (
  SELECT suffix, sum(k) AS k, sum(n) AS n, avg(pow(k / n, 2)) - pow(avg(k / n), 2) AS v FROM d GROUP BY suffix
), a AS (
  SELECT m0, least(100.0, greatest(1.0, 4.0 * m0 * (1 - m0) / (v + 1e-6))) AS s0 FROM (
    SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m0, coalesce(avg(pow(k / n, 2)) - pow(avg(k / n), 2), 0) AS v FROM s)
), s1 AS (
  SELECT suffix, m1, least(100.0, greatest(1.0, 4.0 * m1 * (1 - m1) / (v + 1e-6))) AS s1 FROM (
    SELECT suffix, (k + m0 * s0) / (n + s0) AS m1, v FROM s, a)
), d1 AS (
  SELECT domain, m2, least(100.0, greatest(1.0, 4.0 * m2 * (1 - m2) / (v + 1e-6))) AS s2 FROM (
    SELECT domain, (k + m1 * s1) / (n + s1) AS m2, v FROM d JOIN s1 USING (suffix))
), h1 AS (
  SELECT host, (k + m2 * s2) / (n + s2) AS m3, n + s2 AS s3 FROM h JOIN d1 USING (domain)
), every AS (
  SELECT host, {DOMAIN} AS domain, {SUFFIX} AS suffix
  FROM (SELECT DISTINCT host FROM r)
), known AS (
  SELECT host, coalesce(m3, m2, m1, m0) AS block_rate, coalesce(s3, s2, s1, s0) AS strength, coalesce(m3, m2, m1) IS NOT NULL AS has_outcomes
  FROM every LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), a
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NULL THEN CASE WHEN has_outcomes AND block_rate - 1.645 * sqrt(block_rate * (1 - block_rate) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN known USING (host)
""".replace("{DOMAIN}", DOMAIN).replace("{SUFFIX}", SUFFIX)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), two_label_suffixes=url_filter.TWO_LABEL_SUFFIXES).select("page_id", "host", "path", "rule", "verdict")
