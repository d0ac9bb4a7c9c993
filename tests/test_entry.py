"""The entry gives the engine's own queries whatever part of the optional ones can't be imported."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
from tarn import catalog
every, sql = entry.queries(), entry.oracle_sql()
assert set(catalog.QUERIES) <= set(every) and set(catalog.SQL) <= set(sql) <= set(every)
print(sorted(set(every) - set(catalog.QUERIES)))
"""


@pytest.mark.parametrize("name", ["zstandard", "public_tokenizers", "corpus_pipeline", "tarn.llm"])
def test_a_missing_part_leaves_the_rest(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    extra = done.stdout.strip().splitlines()[-1]
    assert "pipeline" not in extra
    if name in ("zstandard", "tarn.llm"):
        assert extra == "[]"
