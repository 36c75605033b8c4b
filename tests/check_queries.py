"""Compare registered queries with their SQL: python tests/check_queries.py [folder] [name …]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from compare import connect, differences
from locusframe.plans import CHECKS, QUERIES


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in CHECKS:
                found = differences(df, con, CHECKS[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} {time.time() - start:.1f}s {'' if name in CHECKS else '(no sql)'} {'; '.join(found)}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
