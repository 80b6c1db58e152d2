"""The driver entry with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 150 and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
from tests.session import session
print("rows", names["global_mean"](session(), "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("left", ["corpus_pipeline.py", "empty folder", None])
def test_import_without_the_subpackage(tmp_path, left):
    """A copy without both folders imports and answers, whether or not the pipeline or an empty folder stays behind."""
    copy = tmp_path / "copy"
    skipped = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if left == "corpus_pipeline.py" else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skipped)
    if left == "empty folder":
        (copy / "heldout" / "llm" / "__pycache__").mkdir(parents=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]
