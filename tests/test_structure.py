"""The language subpackage is optional, and the entry module works with and without it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(?:from|import)\s+tidemark\.llm", path.read_text()), path


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p7_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from tidemark.__main__ import main

    assert main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert main(["explain", "nsr", sf_dir]) == 0 and "Physical Plan" in capsys.readouterr().out
    assert main(["run", "nsr", sf_dir, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 0
