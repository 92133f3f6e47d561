"""The driver contract where what the training-data operators need is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from testbed.catalogue import QUERIES

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == MISSING or name == MISSING:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as contract
print(len(contract.queries()), len(contract.oracle_sql()))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "glasspool.llm", "corpus_pipeline"])
def test_ledger_queries_do_not_need_the_others(missing):
    code = CODE.replace("MISSING", repr(missing))
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    queries, oracles = map(int, done.stdout.split()[-2:])
    assert queries >= len(QUERIES) and oracles >= len(QUERIES)
    if missing == "ahocorasick":  # the pipeline does not need it
        assert (queries, oracles) == (len(QUERIES) + 1, len(QUERIES))
    if missing == "glasspool.llm":
        assert queries == oracles == len(QUERIES)
