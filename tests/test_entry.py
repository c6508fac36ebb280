import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_entry(spark):
    r = entry.entry(spark).first()
    assert r.n == 500 and -1 <= r.ari <= 1 and 0 <= r.nmi <= 1


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """The subpackage taken out, with only compiled files left behind."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "gyrolith", tmp_path / "gyrolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "gyrolith" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 80 and out[1:] == ["False", "True"]
