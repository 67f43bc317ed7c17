"""python tests/verify_oracle.py [SF_DIR] [NAME...]: each query beside its SQL, compared without regard to order."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as E
from plumbline.session import get_spark
from plumbline.sources import TABLES


def norm(v):
    import datetime
    import decimal

    if isinstance(v, float):
        return f"{v:.10g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.10g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def same(spark, con, d, name):
    df = E.queries()[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(E.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(rel.columns) == cols, (name, rel.columns, cols)
    assert got == want, (name, len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3])
    return len(got)


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


if __name__ == "__main__":
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = get_spark(cores=8), connect(d), 0
    for n in sys.argv[2:] or E.oracle_sql():
        try:
            print(n, same(spark, con, d, n), flush=True)
        except Exception as e:
            bad += 1
            print("BAD", n, str(e)[:600], flush=True)
    sys.exit(bad)
