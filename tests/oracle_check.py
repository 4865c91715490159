"""Run registered queries against their oracle SQL: `python tests/oracle_check.py [sf] [name ...]`."""

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from bazaarlens.sources.tables import TABLES  # noqa: E402


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, int):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    raise TypeError(type(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def oracle(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return took, len(got), "rows only" if got else "NO ROWS"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return took, len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return took, len(got), "ok" if got else "EMPTY"
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return took, len(got), f"DIFF {len(a)} vs {len(b)} spark={only_a} sql={only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from bazaarlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    con = oracle(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        try:
            took, n, verdict = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # report every query, then fail
            took, n, verdict = 0, 0, f"ERROR {type(e).__name__}: " + " ".join(str(e).split())[:700]
        bad += verdict.split()[0] not in ("ok", "rows")
        print(f"{name:28} {took:6.2f}s {n:7} {verdict}", flush=True)
    print("bad:", bad)
    sys.exit(bad > 0)
