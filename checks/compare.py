"""Run every query beside its SQL and compare rows. Usage: compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from checks.local import with_scratch  # noqa: E402
from checks.oracle import ORACLE  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from pagelens.session import build_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    with_scratch(spark)
    duck = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    failures = 0
    for name in names or QUERIES:
        started = time.time()
        frame = QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        got = sorted(map(repr, (tuple(r) for r in frame.select(columns).collect())))
        spark_time = time.time() - started
        if name not in ORACLE:
            print(f"{name}: {len(got)} rows, no SQL")
            continue
        started = time.time()
        result = duck.execute(ORACLE[name])
        order = [d[0] for d in result.description]
        positions = [order.index(c) for c in columns] if sorted(order) == columns else None
        rows = result.fetchall()
        sql_time = time.time() - started
        if positions is None:
            print(f"{name}: COLUMNS {columns} {sorted(order)}")
            failures += 1
            continue
        want = sorted(repr(tuple(r[i] for i in positions)) for r in rows)
        same = got == want
        failures += not same
        print(f"{name}: {'ok' if same else 'DIFF'} {len(got)} {len(want)} "
              f"spark {spark_time:.1f}s sql {sql_time:.1f}s", flush=True)
        if not same:
            print("  spark only:", sorted(set(got) - set(want))[:2])
            print("  sql only:  ", sorted(set(want) - set(got))[:2])
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
