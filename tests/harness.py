"""Run a registered query and its SQL over the same parquet files and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, int):
        return v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, len(got[1]), t1 - t0, 0.0, "rows only"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    msg = ""
    if got[0] != want[0]:
        msg = f"columns {got[0]} vs {want[0]}"
    elif len(got[1]) != len(want[1]):
        msg = f"rows {len(got[1])} vs {len(want[1])}"
    elif got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        msg = f"{len(bad)} rows differ, e.g. spark={bad[0][0]} sql={bad[0][1]}"
    return not msg, len(got[1]), t1 - t0, t2 - t1, msg


def main(argv):
    from crowdtape.queries import load_all
    from crowdtape.session import get_spark

    sf = argv[0]
    pats = argv[1:]
    spark = get_spark(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = load_all()
    con = duck(sf)
    bad = 0
    for name, fn in queries.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            ok, n, a, b, msg = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as ex:  # report and go on
            ok, n, a, b, msg = False, -1, 0, 0, f"{type(ex).__name__}: {str(ex)[:400]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:7d} spark={a:6.2f}s sql={b:5.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
