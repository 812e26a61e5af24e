import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, 'advantages_scaled' in q)"


@pytest.mark.parametrize("taken_out", [["rewardmill/llm"], ["rewardmill/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_operators(tmp_path, taken_out):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *[os.path.basename(t) for t in taken_out]))
    assert not any((copy / t).exists() for t in taken_out)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    n, oracles, pipeline, own = done.stdout.split()[-4:]
    assert int(n) > 80 and (oracles, pipeline, own) == ("True", "False", "True")
