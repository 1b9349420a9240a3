"""The contract module stands without the optional operators and without what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_HIDE = """
import importlib.abc, sys, warnings
sys.path.insert(0, {root!r})
class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError("no " + name, name=name)
sys.meta_path.insert(0, Hidden())
warnings.simplefilter("always")
import __spark_entry__ as contract
print(len([n for n in contract.queries() if not n.startswith("op") and n != "pipeline"]),
      len([n for n in contract.queries() if n[:3] in ("op1", "op6")]))
"""


@pytest.mark.parametrize("name", ["ahocorasick", "zstandard"])
def test_a_missing_module_leaves_out_the_optional_operators(name):
    done = subprocess.run(
        [sys.executable, "-c", _HIDE.format(root=ROOT, name=name)], capture_output=True, text=True, timeout=120
    )
    core, optional = map(int, done.stdout.split())
    assert core > 120 and optional == 0
    if os.path.isdir(os.path.join(ROOT, "termloom", "llm")):
        assert f"no module {name}" in done.stderr
