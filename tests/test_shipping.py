"""Tasks must run where the package is not installed and the working folder is another one."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.append({root!r})
import __spark_entry__ as entry
from quillgrid.session import build_session
spark = build_session(master="local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
queries = entry.queries()
for name in ("profile_correlations", "window_anchored_counts", "stream_attempts"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""


def test_tasks_bring_their_code(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300, check=False,
    )
    assert "all ran" in ran.stdout, ran.stderr[-2000:]
