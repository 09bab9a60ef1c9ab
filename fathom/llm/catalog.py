"""The queries opN_<name> and their SQL, from the query modules of this package."""

from fathom.llm import query_chat, query_decontaminate, query_filter_audit, query_line_dedup, query_ngram_join, query_packing, query_periodic_runs, query_pii, query_quality, query_substring, query_token_counts, query_toxicity, query_url

MODULES = (query_ngram_join, query_line_dedup, query_pii, query_substring, query_quality, query_chat, query_decontaminate, query_packing, query_url, query_toxicity, query_periodic_runs, query_token_counts, query_filter_audit)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if m.ORACLE}
