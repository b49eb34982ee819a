"""Workers find the package when the driver runs in another folder with a session of its own."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
queries = entry.queries()
for name in ("quarantine", "encode_text_bytes", "resample"):
    print(name, len(queries[name](spark, {sf!r}).collect()))
"""


def test_plain_session_in_another_folder(sf, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, sf=sf)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "encode_text_bytes 200" in done.stdout and "resample 48000" in done.stdout
