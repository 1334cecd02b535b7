import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"


@pytest.mark.parametrize("gone", [("spindle/llm", "tests/llm"), ("spindle/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, gone):
    """The registry stands where the operators for training data were taken away, with or without the pipeline."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, own, registered = said.stdout.split()
    assert int(n) > 80 and own == "0" and registered == "True"
