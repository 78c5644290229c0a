"""Every query in a session whose workers cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import importlib.util, os, sys
root = sys.argv[1]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.python.use.daemon", "true").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.range(4).repartition(2).mapInArrow(lambda it: it, "id long").count()  # workers fork from here on, before the driver knows the package
sys.path.insert(0, root)
import __spark_entry__ as entry
def alone(_):
    import importlib.util
    return importlib.util.find_spec("folioscript") is None
assert all(spark.sparkContext.parallelize(range(2), 2).map(alone).collect()), "a worker finds the package"
for name, query in entry.queries().items():
    if name.startswith(("op", "pipeline")) and name[2:3].isdigit() or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-4000:]
    assert len(done.stdout.split("\n")) >= 14
