"""Times the headline queries: one JSON line. Each query runs once to warm up and then three times; the least counts."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["tpch_q01", "tpch_q03", "tpch_q06", "tpch_q12_like", "tpch_q14", "ssb_q11_like", "ssb_q21_like", "ssb_q41_like", "agg_count_distinct", "join_composite", "win_running", "distinct_on", "topn_offset"]
#: Whole passes over a table into a CSV file: Parquet to CSV, CSV to CSV, and CSV to CSV with a filter.
MOVES = {"move_parquet_csv": "SELECT * FROM 'lineitem.parquet'", "move_csv_csv": "SELECT * FROM '{out}/m1.csv'", "move_csv_csv_filtered": "SELECT * FROM '{out}/m1.csv' WHERE l_quantity = 1"}


def main() -> None:
    import tempfile

    from millrace import session
    from millrace.plans import catalogue
    from millrace.runtime import Engine, Run

    os.environ.setdefault("MILLRACE_MEMORY", "12g")
    spark = session.local(CPUS)
    known, took = catalogue.queries(), {}

    def timed(name: str, run) -> None:
        best = None
        for i in range(RUNS + 1):
            began = time.perf_counter()
            run()
            if i:
                best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 4)

    for name in HEADLINE:
        timed(name, lambda name=name: known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory() as out:
        for i, (name, q) in enumerate(MOVES.items(), 1):
            script = f"LOAD INTO '{out}/m{i}.csv' AS {q.format(out=out)}"
            timed(name, lambda script=script: Engine(spark, Run(root=SF_DIR)).run(script))
    print(json.dumps({"metric": "total_seconds_headline", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
