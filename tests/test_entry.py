"""The driver's contract, with and without the subpackage of text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_core_runs_without_text_operators():
    code = "import sys; sys.modules['papyrion.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'bm25_search' in q and 'p8_ids' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "papyrion").rglob("*.py"):
        if "llm" not in p.parts:
            assert "papyrion.llm" not in p.read_text(), p
