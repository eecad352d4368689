"""The driver's entry: every query is registered with a function, and SQL names a registered query."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert {"multi_hop_contacts", "contact_pairs", "geo_ind_trips"} <= set(sql)


def test_imports_without_the_text_operators(tmp_path):
    copytree(ROOT, tmp_path / "repo", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True)


def test_every_tracing_query_has_sql():
    from hopwise.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
