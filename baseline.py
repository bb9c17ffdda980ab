"""Times the headline queries' SQL on one core of DuckDB at $BENCH_SF_DIR: the single-node baseline that bench.py is held against."""

from __future__ import annotations

import json
import os
import time
from statistics import median

import duckdb

from bench import NAMES
from kinetra.plans import catalog

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect(config={"threads": 1})
    for name in ("nation", "orders", "lineitem", "events", "embeddings", "part", "supplier", "region"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    seconds = {}
    for name in NAMES:
        if name in catalog.ORACLE_SQL:
            took = []
            for _ in range(RUNS):
                began = time.perf_counter()
                con.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
                took.append(time.perf_counter() - began)
            seconds[name] = round(median(took), 3)
    print(json.dumps({"metric": "baseline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
