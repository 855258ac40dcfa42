"""The driver contract, also without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "key" in df.columns


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_import_without_llm(tmp_path, gone):
    """With both folders deleted, and with the pipeline deleted too."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__"))
    assert not (copy / "sievecraft" / "llm").exists() and not (copy / "tests" / "llm").exists()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k == 'pipeline' or k.startswith('op') and k[2:3].isdigit() for k in [*e.queries(), *e.oracle_sql()]))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "sievecraft").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("allm", ""), p
