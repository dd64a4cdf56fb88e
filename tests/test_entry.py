"""The driver's entry with and without the optional part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"


def asked(folder: Path) -> tuple[str, str]:
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return done.stdout.strip(), done.stderr


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


@pytest.mark.parametrize("left_over", [False, True])
def test_queries_stay_when_the_optional_part_is_deleted(copy, left_over):
    from barloom.verify.queries import REGISTRY

    shutil.rmtree(copy / "barloom/llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    if left_over:  # what the interpreter leaves behind looks like a namespace package
        (copy / "barloom/llm/__pycache__").mkdir(parents=True)
    out, said = asked(copy)
    assert out == f"{len(REGISTRY)} {len(REGISTRY)} False" and "left out" in said


def test_a_missing_library_is_said_and_costs_no_other_query(copy):
    from barloom.verify.queries import REGISTRY

    for name in ("ahocorasick", "zstandard", "xxhash"):
        (copy / f"{name}.py").write_text("raise ImportError('not installed')\n")
    out, said = asked(copy)
    assert out == f"{len(REGISTRY)} {len(REGISTRY)} False" and "left out" in said
