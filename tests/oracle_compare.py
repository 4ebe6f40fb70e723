"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Mirrors the driver's gate: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402

from filtra.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        out.append(tuple(canon(r[i]) for i in order))
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs = entry.queries()
    sql = entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = rows_of(scols, [tuple(r) for r in sdf.collect()])
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(name, "SPARK_ERROR", repr(e)[:800], flush=True)
            continue
        ts = time.time() - t0
        if name not in sql:
            results[name] = ("NO_ORACLE", len(srows))
            if verbose:
                print(f"{name}: no oracle, {len(srows)} rows, {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sql[name])
            dcols = rel.columns
            drows = rows_of(dcols, rel.fetchall())
        except Exception as e:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", repr(e)[:400])
            if verbose:
                print(name, "DUCK_ERROR", repr(e)[:800], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_rows = srows == drows
        status = "OK" if (ok_cols and ok_rows) else "MISMATCH"
        results[name] = (status, len(srows), len(drows))
        if verbose:
            print(f"{name}: {status} spark={len(srows)} duck={len(drows)} {ts:.1f}s"
                  + ("" if ok_cols else f" cols {sorted(scols)} vs {sorted(dcols)}"), flush=True)
            if ok_cols and not ok_rows:
                sa, da = set(srows), set(drows)
                print("  only spark:", sorted(sa - da, key=repr)[:3])
                print("  only duck :", sorted(da - sa, key=repr)[:3])
    return results


if __name__ == "__main__":
    from filtra.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "NO_ORACLE")}
    print("SUMMARY", len(res), "queries,", len(bad), "bad:", sorted(bad))
