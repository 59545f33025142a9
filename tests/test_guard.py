"""The rest works without the llm folders and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_other_tests_need_no_llm(tmp_path):
    """With both folders and the pipeline away, all other tests are collected, and one file of them passes."""
    for name in ("tessella", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    pytest_ = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    subprocess.run([*pytest_, "--collect-only", "tests"], cwd=tmp_path, check=True, capture_output=True)
    subprocess.run([*pytest_, "tests/test_sources.py", "-k", "rules or logs"], cwd=tmp_path, check=True, capture_output=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tessella.llm" not in p.read_text()
