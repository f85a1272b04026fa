"""The driver contract without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDDEN = """
import sys
sys.path.insert(0, {root!r})


class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemark.llm") or name in {also!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)


sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries() if n[2:3].isdigit() or n == "pipeline")
print(len(entry.queries()), len(entry.oracle_sql()))
"""


def registered(also):
    done = subprocess.run(
        [sys.executable, "-c", HIDDEN.format(root=str(ROOT), also=also)], capture_output=True, text=True, timeout=300, cwd=str(ROOT))
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()))


def test_import_without_the_subpackage():
    from workloads import load_all
    from workloads.registry import ORACLES, QUERIES
    load_all()
    core = [n for n in QUERIES if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]
    assert registered(()) == registered(("corpus_pipeline",)) == (len(core), len([n for n in ORACLES if n in core]))
