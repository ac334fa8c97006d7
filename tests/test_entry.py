"""The driver's entry: with and without the folders for training data."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_entry_without_the_training_data_folders():
    hidden = """
import importlib.util as u
found = u.find_spec
u.find_spec = lambda name, *a: None if name in ("hexwarden.llm", "corpus_pipeline") else found(name, *a)
import __spark_entry__ as e, sys
assert not [m for m in sys.modules if m.startswith(("hexwarden.llm", "corpus_pipeline"))]
print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())
"""
    names = _names(hidden)
    assert len(names) == 83 and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert names <= _names("import __spark_entry__ as e; print(*e.queries())")


def test_nothing_else_imports_the_training_data_folders():
    for path in [*ROOT.glob("hexwarden/**/*.py"), *ROOT.glob("checks/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts and path.name != "test_entry.py":
            assert "llm" not in path.read_text(), path
