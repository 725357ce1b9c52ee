"""Runs queries next to their SQL: python tests/compare.py [sf0.01] [name ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from skein.session import build_session  # noqa: E402


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if hasattr(v, "tzinfo") and v.tzinfo is not None:
            v = v.replace(tzinfo=None)
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def duck(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def main(args):
    folder = "/root/testdata/" + (args[0] if args else "sf0.01")
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    q, s, bad = entry.queries(), entry.oracle_sql(), 0
    c = duck(folder)
    for name in args[1:] or q:
        t = time.time()
        df = q[name](spark, folder)
        got = canonical([tuple(r) for r in df.collect()], df.columns)
        t = time.time() - t
        if name not in s:
            print(f"{name}: {len(got)} rows, {t:.1f} s, no SQL", flush=True)
            continue
        r = c.execute(s[name])
        names = [d[0] for d in r.description]
        want = canonical(r.fetchall(), names)
        ok = got == want and sorted(names) == sorted(df.columns)
        bad += not ok
        print(f"{name}: {len(got)} rows, {t:.1f} s, {'same' if ok else 'DIFFERENT'}", flush=True)
        if not ok:
            a, b = set(got), set(want)
            print("  columns", sorted(df.columns), sorted(names), "\n  only Spark", sorted(a - b)[:3], len(a - b), "\n  only SQL", sorted(b - a)[:3], len(b - a), len(want))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
