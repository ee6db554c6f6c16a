"""Run registered queries against their SQL text and report every difference.

Usage: python tools/check_oracles.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pocketlake.plans.catalog import ORACLES, QUERIES  # noqa: E402
from pocketlake.runtime import local_session  # noqa: E402


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    module = wanted.pop(0)[1:] if wanted and wanted[0].startswith("@") else None
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    bad = 0
    for name, run in QUERIES.items():
        if module and not run.__module__.endswith(module):
            continue
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            order = sorted(df.columns)
            at = [df.columns.index(c) for c in order]
            got = sorted(tuple(canonical(r[i]) for i in at) for r in rows)
            if name not in ORACLES:
                print(f"rows-only {name}: {len(got)} rows {took:.2f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(ORACLES[name])
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            fetched = cur.fetchall()
            sql_took = time.time() - start
            if sorted(names) != order:
                raise AssertionError(f"columns differ: {order} vs {sorted(names)}")
            at = [names.index(c) for c in order]
            want = sorted(tuple(canonical(r[i]) for i in at) for r in fetched)
            wide = [c for c, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]
            if wide:
                print(f"  note {name}: wide types in SQL: {wide}")
            if got != want:
                only_got = sorted(set(got) - set(want))[:3]
                only_want = sorted(set(want) - set(got))[:3]
                raise AssertionError(f"{len(got)} vs {len(want)} rows\n    spark: {only_got}\n    sql:   {only_want}")
            print(f"ok {name}: {len(got)} rows {took:.2f}s (sql {sql_took:.2f}s)", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(exc)[:900]}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
