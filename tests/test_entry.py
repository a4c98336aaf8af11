"""The engine's queries are there without the corpus operators or a library that these alone need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]

CODE = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"no {{name}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") and n[2].isdigit() for n in e.queries()))
"""


@pytest.mark.parametrize("name", ["thermoline.llm", "public_tokenizers", "corpus_pipeline"])
def test_engine_alone(name):
    out = subprocess.run([sys.executable, "-c", CODE.format(name=name)], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert int(out[-2]) > 90
    assert name == "corpus_pipeline" or out[-1] == "False"


def test_own_faults_are_not_hidden():
    got = subprocess.run([sys.executable, "-c", CODE.format(name="thermoline.sources.staging")], capture_output=True, text=True, check=False, cwd=ROOT)
    assert got.returncode != 0 and "no thermoline.sources.staging" in got.stderr
