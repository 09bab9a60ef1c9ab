"""Query op4: words of all documents that stand in a window of an earlier document."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import substring_dedup
from fathom.sources.tables import table

NAME = "op4_substring_dedup"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 49) + 1)) AS i FROM d)
), least AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (g) WHERE doc_id > first_doc
), kept AS (
  SELECT x.doc_id AS doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))
