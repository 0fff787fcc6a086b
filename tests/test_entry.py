"""The driver entry with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'bm25_top5' in q; print(sorted(k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [["lodestone/llm", "tests/llm"], ["lodestone/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        at = copy / g
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[]"
