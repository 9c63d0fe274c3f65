"""The driver contract, with and without the training-data subpackage."""

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).collect()[0]["n"] > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 90


def test_without_training_data_operators(tmp_path):
    """In a copy from which the subpackage, its tests and the pipeline are deleted."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = (
        "import __spark_entry__ as e, sys\n"
        "q = e.queries(); e.oracle_sql()\n"
        "assert 'join_inner' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)\n"
        "assert not [m for m in sys.modules if m.startswith('askframe.llm')]\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env=env)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], check=True, cwd=tmp_path / "copy", env=env, stdout=subprocess.DEVNULL)


def test_training_data_queries():
    if importlib.util.find_spec("askframe.llm"):
        names = list(__spark_entry__.queries())
        assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"
