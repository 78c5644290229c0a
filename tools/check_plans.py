"""List plan shapes worth a look in every registered query.

usage: python tools/check_plans.py [sf]
"""

from __future__ import annotations

import os
import re
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from folioscript.plans.registry import all_queries  # noqa: E402

LOOK_FOR = ["BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for name, (fn, _) in all_queries().items():
        plan = fn(spark, f"/root/testdata/sf{sf}")._jdf.queryExecution().executedPlan().toString()
        found = [f"{w} x{plan.count(w)}" for w in LOOK_FOR if w in plan]
        shuffles = len(re.findall(r"Exchange hashpartitioning", plan))
        if found or shuffles > 9:
            print(f"{name}: {shuffles} shuffles {', '.join(found)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
