"""Run registered queries against their SQL in DuckDB and report differences.

    python tools/compare.py [sf_dir] [query ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb

from pulsewatch.plans.catalog import ORACLES, QUERIES
from pulsewatch.session import build_session


def register(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(map(repr, (plain(r[i]) for i in order))) for r in rows)


def compare(spark, con, name, sf_dir):
    """(equal, spark rows, message)."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return True, len(got), "no SQL"
    rel = con.sql(ORACLES[name])
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, len(got), f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    note = {c: (t, types[c]) for c, t in df.dtypes if PAIRS.get(t) != types[c]}
    if got != want:
        have, need = set(got), set(want)
        only = [x for x in got if x not in need][:2], [x for x in want if x not in have][:2]
        return False, len(got), f"{len(want)} rows wanted; {only} {note}"
    return True, len(got), str(note or "")


PAIRS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
              "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = register(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, n, message = compare(spark, con, name, sf_dir)
        except Exception as err:
            ok, n, message = False, 0, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24} {n:7} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
