"""The other queries stay when a library of the operators is missing."""

import subprocess
import sys

from tests.conftest import ROOT

LACKING = """
import sys
sys.modules["ahocorasick"] = None
import __spark_entry__ as e
names = set(e.queries())
assert "replacement_candidates" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_a_library():
    subprocess.run([sys.executable, "-c", LACKING], cwd=ROOT, check=True, timeout=120)


def test_no_local_folder_on_a_cluster():
    import pytest

    from mendweave.llm import common

    class Nothing:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def isDefined(self):
            return False

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"_jsc": Nothing(), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session())
