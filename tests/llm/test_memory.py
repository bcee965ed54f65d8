"""What the driver asks of executors that are processes of their own."""

from __future__ import annotations

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import json
import time
from pathlib import Path
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from findlake.llm.shared import give_back

conf = {"spark.master": "local-cluster[2,1,1500]", "spark.executor.memory": "1400m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()


def held():
    found = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if str(Path.cwd()).encode() in (p / "environ").read_bytes() and b"CoarseGrainedExecutorBackend" in (p / "cmdline").read_bytes():
                found[p.name] = int((p / "status").read_text().split("RssAnon:")[1].split()[0]) // 1024
        except OSError:
            pass
    return found


rows = spark.range(0, 1_500_000, 1, 8).select((F.col("id") % 7_001).alias("k"), F.repeat(F.lit("word "), 60).alias("v"), F.xxhash64("id").alias("h"))
for _ in range(4):
    rows.repartition(4, "k").sortWithinPartitions("h").write.format("noop").mode("overwrite").save()
before = held()
give_back(spark)
time.sleep(2)  # the JVM gives regions back in the background
print("HELD", json.dumps([before, held()]), flush=True)
spark.stop()
"""


def test_executors_give_their_heap_back_between_stages(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # the executors' folders
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    repo = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    said = [x for x in run.stdout.splitlines() if x.startswith("HELD")]
    assert said, run.stderr[-2000:]
    before, after = json.loads(said[0][5:])
    grown = [pid for pid, mb in before.items() if mb > 200]
    assert len(grown) == 2, said
    assert all(after[pid] < before[pid] - 50 for pid in grown), said
