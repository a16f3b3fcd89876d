"""The entry without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["factweave/llm", "tests/llm", "corpus_pipeline.py"], ["factweave/llm"], ["corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = tmp_path / "copy" / name
        shutil.rmtree(path, ignore_errors=True) if not path.is_file() else path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bounds_check' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
