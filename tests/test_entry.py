"""The entry module works when the training-data subpackage is taken away."""
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as E
names, twins = set(E.queries()), set(E.oracle_sql())
assert "km_mortality" in names and twins <= names, twins - names
assert not any(n == "pipeline" or n.startswith("op") and n[2:3].isdigit() for n in names | twins)
"""


@pytest.mark.parametrize("left", ["nothing", "empty folder", "no pipeline"])
def test_entry_without_training_data_operators(tmp_path, left):
    keep = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    if left == "empty folder":
        (tmp_path / "copy/cohortlab/llm/__pycache__").mkdir(parents=True)
    if left == "no pipeline":
        (tmp_path / "copy/corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
