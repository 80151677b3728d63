"""The driver's entry without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e, bench
names = e.queries()
assert "temporal_median_mad" in names and set(e.oracle_sql()) <= set(names)
assert not any(n == "pipeline" or n[:2] == "op" and n[2:3].isdigit() for n in names), names
"""


@pytest.mark.parametrize("gone", [["strataflow/llm"], ["strataflow/llm", "corpus_pipeline.py"]])
def test_the_rest_lives_without_the_subpackage(tmp_path, gone):
    for name in ("strataflow", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
