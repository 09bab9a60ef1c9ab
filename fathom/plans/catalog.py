"""All queries of the engine outside the training-data operators, by name, with their SQL."""

from fathom.plans import index_queries, record_queries, search_queries, table_queries, text_queries

MODULES = (search_queries, text_queries, table_queries, record_queries, index_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
