"""The entry without the training-data part: on a copy of the repository, in a process of its own."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["petrichor/llm"], ["corpus_pipeline.py"], ["petrichor/llm", "corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *[Path(g).name for g in gone]))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k[:2] == 'op' or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    all_of, trained = map(int, out.stdout.split())
    assert all_of - trained > 200
    if "petrichor/llm" in gone:
        assert trained == 0
