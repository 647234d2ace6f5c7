"""The entry module can be read without a session, and queries and SQL fit together."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    r = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-800:]


def test_core_does_not_know_llm():
    for p in (ROOT / "lexloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lexloom.llm" not in p.read_text(), p
