"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [KEY ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from oncolattice.catalog import QUERIES
from oncolattice.session import get_session

HEADLINE = [
    "CAS1", "CAS4", "CAS7", "CAS8", "SRC9", "RTE2", "RTE6", "GND7",
    "CHK7", "CHK8", "CHK10", "CHK11", "EXT2", "EXT9", "EXT10",
    "RES3", "RES8", "RES9", "RES10", "GRF1", "GRF5", "GRF13", "ALG3", "ALG6",
    "PTH1", "PTH4", "RET1", "RET2", "RET4", "RET14", "VAL14", "VEC4", "RDF9", "SNK1",
    "STR1", "build", "answer",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__driver__memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/events.parquet").selectExpr("sum(value)").collect()  # start the workers
    took = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, path).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {took[key]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
