"""Runs registered queries against their reference SQL; ``python tests/oracle_compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata"
TIMES: list[float] = []


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    start = time.time()
    actual = fn(spark, sf_dir).toPandas()
    middle = time.time()
    expected = con.execute(sql).df()
    TIMES[:] = [round(middle - start, 1), round(time.time() - middle, 1)]
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}", len(actual)
    a, e = rows_of(actual), rows_of(expected)
    if len(a) != len(e):
        return f"rows {len(a)} != {len(e)}; spark {a[:2]} sql {e[:2]}", len(actual)
    bad = [(x, y) for x, y in zip(a, e) if x != y]
    kinds = [(c, str(actual[c].dtype), str(expected[c].dtype)) for c in actual.columns if actual[c].dtype.kind != expected[c].dtype.kind]
    note = f" kinds differ {kinds}" if kinds else ""
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else "ok" + note), len(actual)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sitegauge.session import build

    sf = f"{ROOT}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:]
    spark = build("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in [n for n in qs if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]:
        start = time.time()
        try:
            if name in sqls:
                result, n = compare(spark, con, sf, qs[name], sqls[name])
            else:
                n, result = qs[name](spark, sf).count(), "ok (rows only)"
        except Exception as error:  # noqa: BLE001
            n, result = -1, f"ERROR {type(error).__name__} {str(error)[:600]}"
        failed += not result.startswith("ok")
        print(f"{'PASS' if result.startswith('ok') else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {TIMES} {'' if result == 'ok' else result}", flush=True)
    print(f"{failed} failed")
