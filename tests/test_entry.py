"""The entry module: queries run, names match their SQL, and the training-data package is optional."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_match():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rrf", "graph_neighbors", "measure", "classify_changes"])
def test_a_query_runs(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_without_the_optional_package():
    code = '''import sys; sys.modules['fathom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); print(len(n), any(x[:2] == "op" and x[2:3].isdigit() or x == "pipeline" for x in n))'''
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 50, out.stderr
