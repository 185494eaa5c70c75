"""The contract's functions stand when the training-data operators can't be imported."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
{prepare}
import __spark_entry__ as e
names = e.queries()
assert 'catalog_page' in names and set(e.oracle_sql()) <= set(names)
print(sum(n.startswith('op') and n[2].isdigit() for n in names), 'pipeline' in names)
"""


def queries(prepare):
    done = subprocess.run([sys.executable, "-c", CODE.format(prepare=prepare)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_tokenizers_or_the_subpackage():
    for module in ("public_tokenizers", "folioscope.llm", "folioscope.llm.queries"):
        assert queries(f"sys.modules[{module!r}] = None") == ["0", "False"]


def test_without_the_pipeline():
    number, there = queries("sys.modules['corpus_pipeline'] = None")
    whole, with_pipeline = queries("")
    assert number == whole and there == "False" and (with_pipeline == "True") == (int(whole) > 0)
