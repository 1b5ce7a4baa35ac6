"""Executors that are lost while a query runs: the rows stay whole."""

import json
import os
import subprocess
import sys

import pytest

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_RUN = """
import json, sys, threading, time
from pyspark.sql import SparkSession
import __spark_entry__

name, data, shared = sys.argv[1:]
spark = (
    SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.executor.memory", "700m").config("spark.checkpoint.dir", f"file://{shared}")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
context = spark.sparkContext._jsc.sc()
lost, done = [], threading.Event()

def executors():
    return set(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.getExecutorIds()))

def lose():
    # an executor goes every second or so, as soon as another one is there, until the query has ended
    while not done.wait(1.0) and len(lost) < 4:
        alive = sorted(executors(), key=int)
        if len(alive) > 1 and context.killAndReplaceExecutor(alive[0]):
            lost.append(alive[0])

while len(executors()) < 2:
    time.sleep(0.1)
spark.read.parquet(f"{data}/documents.parquet").count()
thread = threading.Thread(target=lose)
thread.start()
rows = __spark_entry__.queries()[name](spark, data).collect()
done.set()
thread.join()
print("ROWS", json.dumps([lost, sorted(map(str, map(tuple, rows)))]))
spark.stop()
"""


@pytest.mark.parametrize("name", ["op1_token_binary", "op5_jaccard"])
def test_lost_executors_change_nothing(name, spark, data, tmp_path):
    import __spark_entry__

    done = subprocess.run([sys.executable, "-c", _RUN, name, data, str(tmp_path)], cwd=_REPO, capture_output=True, text=True, timeout=900)
    assert "ROWS" in done.stdout, done.stderr[-3000:]
    lost, rows = json.loads(done.stdout.rpartition("ROWS ")[2])
    assert lost
    assert rows == sorted(map(str, map(tuple, __spark_entry__.queries()[name](spark, data).collect())))
