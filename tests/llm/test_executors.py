"""Executors need no copy of the library: the queries run where only the driver can import it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", "wh").config("spark.checkpoint.dir", "file://{here}/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def seen(rows):
    import importlib.util
    yield from [importlib.util.find_spec("framelake") is not None for _ in rows]

assert spark.sparkContext.range(2).mapPartitions(seen).collect() == [False, False], "workers see the library"
import __spark_entry__ as entry
for name in {names!r}:
    entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("DONE", name, flush=True)
"""


def test_without_the_library(tmp_path):
    names = ["op1_substring_dedup", "op4_simhash", "op6_language_id", "op7_quality_classifier", "op8_decontamination", "op9_html_extraction", "pipeline"]
    script = SCRIPT.format(repo=str(Path(__file__).resolve().parents[2]), here=str(tmp_path), names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[1] for x in said.stdout.splitlines() if x.startswith("DONE")] == names, said.stderr[-3000:]
