"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/assayer", tmp_path / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 100, out.stderr


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/assayer"):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "assayer.llm" not in f.read(), name
