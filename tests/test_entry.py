"""The entry module, with and without the part that can be taken out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["host", "captures", "ok", "html"] and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    script = "import __spark_entry__ as e; names = e.queries(); assert 'pipeline' not in names and not any(n.startswith('op1') for n in names); print(len(names), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, oracles = map(int, done.stdout.split())
    assert queries > oracles > 60


def test_nothing_else_imports_it():
    for path in [*ROOT.glob("weftline/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts:
            assert "weftline.llm" not in path.read_text() or path.name == "test_entry.py", path
