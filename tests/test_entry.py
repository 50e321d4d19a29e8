"""The entry imports without a Spark session, with the training-data subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"


def count(folder):
    return int(subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout)


def test_import_with_and_without_the_subpackage(tmp_path):
    from tidemark.queries import QUERIES

    assert count(ROOT) >= len(QUERIES)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert count(tmp_path) == len(QUERIES)
    if (pipeline := ROOT / "corpus_pipeline.py").exists():  # left behind while the folder is gone
        shutil.copy(pipeline, tmp_path)
    assert count(tmp_path) == len(QUERIES)
