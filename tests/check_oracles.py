"""Run every registered query (or those whose name contains an argument) against its SQL twin.

    python tests/check_oracles.py [--sf DIR] [name-part ...]
"""

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import oracle
from evitrust.plans import Tables, load_all


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--loose", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(args.sf)
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(part in name for part in args.names):
            continue
        start = time.time()
        try:
            if q.oracle:
                diffs, n = oracle.compare(spark, q, args.sf, con, strict=not args.loose)
            else:
                diffs, n = [], len(q.run(Tables(spark, args.sf)).collect())
        except Exception as e:  # noqa: BLE001
            diffs, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        bad += bool(diffs)
        mark = "FAIL" if diffs else ("ok  " if q.oracle else "rows")
        print(f"{mark} {name:45s} rows={n:7d} {time.time() - start:6.2f}s", flush=True)
        for d in diffs:
            print("     ", d[:1200], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
