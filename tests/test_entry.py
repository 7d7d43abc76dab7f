"""The entry without its optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert "q_threshold_sweep" in found and set(sql) <= set(found), sorted(set(sql) - set(found))
print(sum(n.startswith("op") or n == "pipeline" for n in found))
"""


def names_left(tmp_path, *gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        target = tmp_path / "repo" / name
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]
    return int(done.stdout.split()[-1])


def test_everything_else_is_registered_without_the_optional_folder(tmp_path):
    assert names_left(tmp_path, "orderlens/llm") == 0


def test_everything_else_is_registered_without_folder_and_pipeline(tmp_path):
    assert names_left(tmp_path, "orderlens/llm", "corpus_pipeline.py") == 0
