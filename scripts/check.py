"""Run registered queries next to their SQL oracles: check.py [prefix,...] [--sf DIR]."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from sheetledger.plans.catalog import entries  # noqa: E402
from sheetledger.session import build_session  # noqa: E402
from sheetledger.sources.tables import SCHEMAS  # noqa: E402

CLASSES = {
    "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "double": "float", "float": "float",
    "string": "str", "varchar": "str", "boolean": "bool", "timestamp": "ts", "date": "date",
}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def close(a, b):
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
    except (TypeError, ValueError):
        return a == b


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="?", default="")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--time", action="store_true", help="run to a noop sink and print seconds only")
    args = ap.parse_args()
    want = [w for w in args.names.split(",") if w]
    os.environ["PYSPARK_SUBMIT_ARGS"] = "--conf spark.ui.showConsoleProgress=false pyspark-shell"
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    bad = 0
    for name, entry in entries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        start = time.time()
        try:
            df = entry.run(spark, args.sf)
            if args.time:
                df.write.format("noop").mode("overwrite").save()
                print(f"rows  {name} {time.time() - start:.1f}s", flush=True)
                continue
            cols = sorted(df.columns)
            got = [tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
            took = time.time() - start
            if entry.sql is None:
                print(f"rows  {name} rows={len(got)} {took:.1f}s", flush=True)
                if not got:
                    print("      EMPTY", flush=True)
                continue
            cur = con.execute(entry.sql)
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]).lower() for d in cur.description}
            if sorted(names) != cols:
                print(f"COLS  {name}: {cols} vs {sorted(names)}", flush=True)
                bad += 1
                continue
            idx = [names.index(c) for c in cols]
            exp = [tuple(r[i] for i in idx) for r in cur.fetchall()]
            odd = [(c, t, kinds[c]) for c, t in df.dtypes
                   if CLASSES.get(t, t) != {"number": "?", "bigint": "int", "integer": "int", "double": "float",
                                            "float": "float", "varchar": "str", "boolean": "bool", "timestamp": "ts",
                                            "date": "date"}.get(kinds[c], kinds[c])]
            a = sorted(tuple(norm(v) for v in r) for r in got)
            b = sorted(tuple(norm(v) for v in r) for r in exp)
            if a == b and not odd:
                print(f"ok    {name} rows={len(a)} {took:.1f}s{' EMPTY' if not a else ''}", flush=True)
                continue
            if a == b:
                print(f"types {name} rows={len(a)} {odd}", flush=True)
                bad += 1
                continue
            bad += 1
            diff = [x for x in zip(a, b) if x[0] != x[1]][:2]
            near = len(a) == len(b) and all(
                close(x.strip("'"), y.strip("'")) for r, s in zip(a, b) for x, y in zip(r, s))
            print(f"{'CLOSE' if near else 'DIFF '} {name} rows={len(a)}/{len(b)} cols={cols} {odd}\n      " +
                  "\n      ".join(f"{x}\n   vs {y}" for x, y in diff), flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__} {str(exc)[:700]}", flush=True)
            if want:
                traceback.print_exc(limit=-4)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
