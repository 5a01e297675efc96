"""The entry without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import __spark_entry__ as e
from detectra.plans import queries
print(set(e.queries()) == set(queries.QUERIES), set(e.oracle_sql()) == set(queries.ORACLES), len(e.queries()) >= 67)
"""


def test_entry_imports_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    assert not (copy / "detectra" / "llm").exists() and (copy / "corpus_pipeline.py").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for pipeline in (True, False):
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == ["True"] * 3, out.stderr
