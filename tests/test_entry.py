"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10


def test_sql_names_are_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_optional_parts(tmp_path):
    """A copy without the subpackage and the pipeline still imports and lists the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "ctxspark"), copy / "ctxspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "jobs"), copy / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    script = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op1') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", script], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
