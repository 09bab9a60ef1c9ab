"""Query op6: all conversations, and one whose texts are control strings."""

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import chat_format
from fathom.sources.tables import table

NAME = "op6_chat_format"
TRAP = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|sep/>)', '\1\\\2\3', 'g')) AS role_len,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|sep/>)', '\1\\\2\3', 'g')) AS text_len,
    role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
  FROM rows
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(text_len + CASE WHEN opens THEN role_len + 20 ELSE 6 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{TRAP}'), (-7L, 1L, 'assistant', '{TRAP}') AS t(conv_id, turn, role, text)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_chats(chats))
