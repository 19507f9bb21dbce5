"""Comparison of a query with its SQL, both over the same tables."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.8g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def same(spark, con, query, sql, sf_dir=DATA):
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    quoted = ", ".join('"' + c + '"' for c in columns)
    wanted = con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
    assert canonical(rows) == canonical(wanted)
