"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The demo model is made first, like a model's load, and has its own figure. A query's
figure is the median of RUNS runs after one that compiles its code.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from glyphon.plans.registry import QUERIES
from glyphon.sources.model import demo_model

NAMES = ["embed_mean", "wordpiece_row_local", "pretokenize", "lower_codepoint", "word_counts", "chunk_256", "l2_norm"]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.time()
    demo_model(spark, sf_dir)
    load, took = time.time() - begin, {}
    for name in NAMES:
        runs = []
        for _ in range(1 + RUNS):
            begin = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - begin)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "model_seconds": round(load, 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
