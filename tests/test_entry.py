"""The entry points without the training-data operators, or without what they import."""

import subprocess
import sys

import pytest

from conftest import ROOT


@pytest.mark.parametrize("missing", ["ahocorasick", "quillmeter.llm", "corpus_pipeline"])
def test_base_queries_stay_without(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
from quillmeter.plans.queries import ORACLE, QUERIES
assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
assert "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
