"""Run registered queries beside their SQL twins: ``python tools/compare.py [-s SF_DIR] [name or prefix* ...]``."""

import argparse
import math
import sys
import threading
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from threadloom.plans import load_all  # noqa: E402
from threadloom.plans.registry import ORACLE, QUERIES  # noqa: E402
from threadloom.session import local_session  # noqa: E402


def kind(v):
    return "null" if v is None else type(v).__name__


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def sorted_rows(columns, rows):
    """Rows by column name and value, floats to five places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(norm(float(v) if isinstance(v, Decimal) else v) for v in (r[i] for i in order)) for r in rows]
    return sorted(plain, key=lambda r: tuple(f"{v:.4f}" if isinstance(v, (int, float)) else str(v) for v in r))


def main():
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("-s", "--sf", default="/root/testdata/sf0.01")
    a = p.parse_args()
    load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(a.sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    chosen = [
        n for n in QUERIES
        if not a.names
        or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)
    ]
    bad = 0
    for n in chosen:
        print(f"  {n} ...", file=sys.stderr, flush=True)
        try:
            t = time.time()
            df = QUERIES[n](spark, a.sf)
            got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
            spent = time.time() - t
            if n not in ORACLE:
                print(f"rows {n}: {len(got)} rows {spent:.1f}s")
                continue
            t = time.time()
            stop = threading.Timer(30, con.interrupt)
            stop.start()
            cur = con.execute(ORACLE[n])
            cols = [d[0] for d in cur.description]
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            want = [tuple(r[i] for i in order) for r in cur.fetchall()]
            stop.cancel()
            ospent = time.time() - t
            problem = None
            if sorted(df.columns) != sorted(cols):
                problem = f"columns {sorted(df.columns)} vs {sorted(cols)}"
            elif len(got) != len(want):
                problem = f"rows {len(got)} vs {len(want)}"
            key = lambda r: tuple((str(norm(v))) for v in r)
            g, w = sorted(got, key=key), sorted(want, key=key)
            if problem is None:
                diff = [(x, y) for x, y in zip(g, w) if [norm(v) for v in x] != [norm(v) for v in y]]
                if diff:
                    problem = f"{len(diff)} differing rows, e.g.\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
                else:
                    types = {(c, kind(u), kind(v)) for x, y in zip(g, w) for c, u, v in zip(sorted(cols), x, y) if kind(u) != kind(v)}
                    if types:
                        problem = f"types {sorted(types)}"
            elif not problem.startswith("columns"):
                extra = [x for x in g if [norm(v) for v in x] not in [[norm(v) for v in y] for y in w]][:2] if len(g) < 3000 else []
                problem += f"\n   spark {g[:2]} extra {extra}\n   sql   {w[:2]}"
            bad += problem is not None
            print(f"{'BAD ' if problem else 'ok  '} {n}: {len(got)} rows, spark {spent:.1f}s sql {ospent:.1f}s {problem or ''}", flush=True)
            if not problem and not got:
                print("     EMPTY", n)
        except Exception as e:
            bad += 1
            print(f"ERR  {n}: {type(e).__name__} {str(e)[:900]}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    main()
