"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_subpackage(tmp_path, pipeline):
    """Both with and without the pipeline's module, and with a folder of stale byte code."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "trendspark", copy / "trendspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (copy / "trendspark" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy)
    found = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, check=True)
    many, known, piped = found.stdout.split()
    assert int(many) > 50 and known == "True" and piped == "False"
