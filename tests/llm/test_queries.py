"""Queries against their SQL, and the entry point with and without this package."""

import subprocess
import sys
from pathlib import Path

import pytest

from sheaf.llm.queries import ORACLE, QUERIES
from tests.compare import mismatch

ROOT = Path(__file__).parents[2]


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert mismatch(QUERIES[name](spark, sf_dir), sf_dir, ORACLE[name]) is None


def test_entry_without_the_package():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("sheaf.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
{}
import __spark_entry__ as e
print(len(e.queries()), any(q.startswith("op") and q[2].isdigit() for q in e.queries()))
"""
    run = lambda hide: subprocess.run([sys.executable, "-c", code.replace("{}", hide)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    without, all_ = run("sys.meta_path.insert(0, Gone())"), run("")
    assert without[1] == "False" and all_[1] == "True"
    assert int(all_[0]) == int(without[0]) + len(QUERIES) + 1
