"""The rest of the library stands without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_text_operators():
    for f in (REPO / "tessera").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "tessera.llm" not in f.read_text()


def test_entry_without_them(tmp_path):
    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and q.keys() == s.keys() and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_package_that_they_need_is_missed_aloud(tmp_path):
    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_package\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as error:\n    assert error.name == 'no_such_package'\nelse:\n    raise SystemExit(1)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
