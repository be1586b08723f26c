"""The driver contract: registry, guard, smoke."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_library_works_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['loomspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for p in (ROOT / "loomspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace('"llm"', "").replace("llm |", ""), p


def test_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
