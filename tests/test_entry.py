"""The entry module with and without the subpackage of training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
known = e.queries()
assert set(e.oracle_sql()) <= set(known) and "jn_budgeted" in known
print(sorted(k for k in known if k.startswith("op") or k == "pipeline"))
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_folders(tmp_path, pipeline):
    """Both folders deleted, with or without the pipeline module that needs them."""
    for name in ("sparkweave", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        at = ROOT / name
        shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if at.is_dir() else shutil.copy(at, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert (done.returncode, done.stdout.strip()) == (0, "[]"), done.stderr


def test_errors_of_a_module_show(tmp_path):
    shutil.copytree(ROOT / "sparkweave", tmp_path / "sparkweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module" in done.stderr
