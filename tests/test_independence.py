"""The library stands without the subpackage of corpus operators, and without the pipeline's module."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("veriloom/llm",), ("veriloom/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_the_library_does_not_name_the_subpackage():
    files = [p for p in (ROOT / "veriloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not [p for p in files if "llm import" in p.read_text() or "veriloom.llm" in p.read_text()]
