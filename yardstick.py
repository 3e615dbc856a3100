"""The batch queries of the dialect in the standard library's SQLite, over the same tables loaded into memory.

Prints one JSON line with seconds of loading and of each query (the faster of two runs, all rows fetched), as a yardstick for ``bench.py``.
"""

from __future__ import annotations

import json
import os
import sqlite3
import sys
import time
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidewell.plans.dialect import parse_one  # noqa: E402
from tidewell.plans.dialect_queries import BATCH  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    db = sqlite3.connect(":memory:")
    began = time.perf_counter()
    for name in sorted({t.name for text, _ in BATCH.values() for t in parse_one(text).tables()}):
        table = pq.read_table(f"{folder}/{name}.parquet")
        db.execute(f"CREATE TABLE {name} ({', '.join(table.column_names)})")
        rows = zip(*(c.cast("string").to_pylist() if "timestamp" in str(c.type) else c.to_pylist() for c in table.columns), strict=True)
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(table.column_names))})", rows)
    loaded, times = time.perf_counter() - began, {}
    for name, (text, _) in BATCH.items():
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            try:
                db.execute(text).fetchall()
            except sqlite3.Error:  # EVERY, or a function that this build doesn't have
                break
            runs.append(time.perf_counter() - began)
        if runs:
            times[name] = round(min(runs), 3)
    print(json.dumps({"load": round(loaded, 3), "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
