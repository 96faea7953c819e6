"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from chronoreel.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_registered():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]


def test_without_subpackage(tmp_path):
    for name in ("chronoreel", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "chronoreel/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(registry.queries())), "False"], out.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "chronoreel").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "chronoreel.llm" not in path.read_text(), path
