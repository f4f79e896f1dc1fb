"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and callable(e.entry); print(sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(q))"


def _said(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)}).stdout.split()


def test_queries_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    ops, pipeline, n = _said(tmp_path)
    assert (ops, pipeline) == ("0", "False") and int(n) > 50


def test_queries_with_the_subpackage_but_no_pipeline_file(tmp_path):
    shutil.copytree(f"{ROOT}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path) if os.path.exists(f"{ROOT}/corpus_pipeline.py") else None
    assert _said(tmp_path)[0] == "0"
