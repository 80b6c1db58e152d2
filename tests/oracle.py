"""Run registered queries next to their DuckDB SQL and report differences.

``python -m tests.oracle [--sf 0.01] [names...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from tests.session import session


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return f"rows={len(got)} (no oracle)" if got else "EMPTY"
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return f"FAIL columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    if len(got) != len(want):
        return f"FAIL rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        types = [(a, type(x).__name__, type(y).__name__) for a, x, y in zip(cols, *bad[0])]
        return f"FAIL {len(bad)}/{len(got)} differ; cols {cols} e.g. {bad[0]} {types if len(types) < 8 else ''}"
    return f"ok rows={len(got)}" if got else "EMPTY"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from heldout.plans.catalog import ORACLE, QUERIES

    names = [n for n in QUERIES if not argv or n in argv or any(a.endswith("*") and n.startswith(a[:-1]) for a in argv)]
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            result = "ERROR " + " ".join(str(e).split())[:700]
        failed += not (result.startswith("ok") or "no oracle" in result)
        print(f"{name:34s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    raise SystemExit(min(1, main(sys.argv[1:])))
