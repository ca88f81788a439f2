import os
import subprocess
import sys
import time

import pytest

from rankloom.storage import small_or_shuffled

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from rankloom.storage import materialize
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
t = materialize(spark.range(10), "numbers")
assert t.count() == 10
if sys.argv[2] == "stop":
    spark.stop()
elif sys.argv[2] == "raise":
    raise SystemExit(3)
"""


@pytest.mark.parametrize("end", ["stop", "exit", "raise"])
def test_nothing_is_left_behind(tmp_path, end):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), end], cwd=root, timeout=120, stderr=subprocess.DEVNULL)
    left = [""]
    for _ in range(60):  # the JVM ends a little after the process
        left = [f for _, _, files in os.walk(tmp_path) for f in files]
        if not left:
            break
        time.sleep(0.5)
    assert left == []


def test_broadcast_by_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) s", "cast('ab' as binary) b", "array(id) a")
    assert hinted(small_or_shuffled(df)) and not hinted(small_or_shuffled(df, most_rows=99)) and not hinted(small_or_shuffled(df, most_bytes=50_000))
    assert hinted(small_or_shuffled(df.limit(0)))
