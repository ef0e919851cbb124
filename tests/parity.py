"""Side-by-side run of the registered queries and their SQL oracles.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from rackpulse.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null" if value is None else "~nan"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in frame_rows), sorted(columns)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got, columns = rows_of([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - started
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        return f"ROWS {len(got):7d} {took:6.1f}s", True
    result = con.execute(oracle)
    want, names = rows_of(result.fetchall(), [d[0] for d in result.description])
    if columns != names:
        return f"COLUMNS differ: {columns} / {names}", False
    if got == want:
        return f"OK   {len(got):7d} {took:6.1f}s", True
    only_spark = sorted(set(got) - set(want))[:3]
    only_sql = sorted(set(want) - set(got))[:3]
    return f"DIFF {len(got)} / {len(want)}\n  cols  {columns}\n  spark {only_spark}\n  sql   {only_sql}", False


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    spark = build_session("local[8]", 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in names:
        try:
            text, ok = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            text, ok = f"ERROR {type(error).__name__}: {str(error)[:1500]}", False
        print(f"{name:28s} {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
