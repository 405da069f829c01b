"""The library without the corpus operators: a copy of the repository that lacks their folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"


def imported(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)},
                          capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("gone", [["packhouse/llm", "tests/llm"], ["packhouse/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_and_lists_its_queries(tmp_path, gone):
    copy = tmp_path / "copy"
    skipped = {ROOT / g for g in gone} | {ROOT / ".git"}
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if Path(folder) / n in skipped or n == "__pycache__"])
    found = imported(copy)
    assert (found.returncode, found.stdout.strip()) == (0, "[]"), found.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "--ignore=tests/test_isolation.py"],
                               cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert collected.returncode == 0, collected.stdout


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("packhouse/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_isolation.py":
            assert "packhouse.llm" not in path.read_text(), path
