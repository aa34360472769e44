"""The relational part stands without the optional one."""

import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_part():
    for file in (ROOT / "marlstone").rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [x.name for x in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), file


def test_every_query_of_the_contract_is_there():
    import __spark_entry__ as entry

    assert {"flagship", "hash_join_inner", "setop_precedence", "nested_correlated", "update_from"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5


def test_the_rest_works_without_the_optional_part(tmp_path):
    """In a copy that lacks the optional folders and the pipeline."""
    for file in ROOT.rglob("*.py"):
        to = tmp_path / file.relative_to(ROOT)
        if "llm" not in file.parts and file.name != "corpus_pipeline.py":
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(file.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert {'flagship', 'sql_drop', 'update_from'} <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) == set(q); import marlstone.__main__, marlstone.streaming.events, bench"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
