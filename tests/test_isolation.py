"""The library's registry without the subpackage of training-data operators, and without the pipeline's module too."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q if n[2:3].isdigit())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_registry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(TOP, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    run = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)
    assert run.returncode == 0, run.stderr
