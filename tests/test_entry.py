"""The driver's entry points, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left_out", [("graphloom/llm", "corpus_pipeline.py"), ("graphloom/llm",), ("corpus_pipeline.py",)])
def test_queries_without_the_corpus_parts(tmp_path, left_out):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", *(Path(p).name for p in left_out))
    shutil.copytree(ROOT, copy, ignore=skip)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'ag3_hot_paths' in q; assert 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100


def test_all_queries_are_callable():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert all(callable(q) for q in e.queries().values())
    assert set(e.oracle_sql()) <= set(e.queries())
