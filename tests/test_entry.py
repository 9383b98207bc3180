"""The entry points hold with and without the training-data subpackage."""

import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert e.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_follow_the_subpackage():
    there = importlib.util.find_spec("cairn.llm") is not None
    assert any(name.startswith("op1_") for name in e.queries()) is there


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_queries_without_the_subpackage(tmp_path, also):
    """On a copy without the subpackage and its tests, with and without the pipeline's file."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
