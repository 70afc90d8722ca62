"""The driver's contract without the optional corpus operators or what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["tidemark.llm", "public_tokenizers", "xxhash"])
def test_core_queries_stay_without(absent):
    code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r} or name.startswith({absent!r} + "."):
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "leading_signals" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 200
