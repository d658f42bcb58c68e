"""The driver's contract, with and without the subpackage llm."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_llm(tmp_path):
    for name in ("sparkloom", "__spark_entry__.py"):
        own = ROOT / name
        (shutil.copytree if own.is_dir() else shutil.copy)(own, tmp_path / name)
    shutil.rmtree(tmp_path / "sparkloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sparkloom.llm" not in p.read_text()
