"""The driver's entry without parts of the repository."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
from lexstrata.registry import QUERIES
assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print(sum(k.startswith("op") for k in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("hidden", [("corpus_pipeline",), ("lexstrata.llm",), ("ahocorasick",)])
def test_missing_parts_leave_the_rest(hidden):
    out = subprocess.run([sys.executable, "-c", LIST.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    if hidden != ("corpus_pipeline",):
        assert out.stdout.split() == ["0", "False"]
    else:
        assert out.stdout.split()[1] == "False"
