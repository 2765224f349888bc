"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    for name in ("scholarspark", "__spark_entry__.py", "corpus_pipeline.py"):
        at = os.path.join(REPO, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 100
