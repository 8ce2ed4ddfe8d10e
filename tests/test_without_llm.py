"""The library works without its optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in ('corpus_pipeline', 'quern.llm') or name.startswith('quern.llm.'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert 'read_time' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_imports_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quern.llm" not in p.read_text()
