"""Run registered queries next to their SQL: python -m tests.oracle_check [name-part ...] [--sf 0.01]"""
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6f}" if not float(v).is_integer() else str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_text(x) for x in v) + "]"
    return str(v)


def canonical(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))
    return cols, rows


def kinds(df):
    def kind(t):
        t = str(t)
        if t.startswith(("int", "uint", "Int")):
            return "int"
        return "float" if t.startswith("float") else "bool" if t.startswith("bool") else "other"
    return {c: kind(df[c].dtype) for c in sorted(df.columns)}


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    spent = time.time() - t0
    if sql is None:
        return True, f"rows-only n={len(got)} {spent:.1f}s"
    t0 = time.time()
    want = con.execute(sql).df()
    sql_spent = time.time() - t0
    a, b = canonical(got), canonical(want)
    if a == b:
        ka, kb = kinds(got), kinds(want)
        diff = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]} if len(got) else {}
        note = f" KINDS {diff}" if diff else ""
        return True, f"ok n={len(got)} spark {spent:.1f}s duck {sql_spent:.1f}s{note}{' EMPTY' if not len(got) else ''}"
    if a[0] != b[0]:
        return False, f"columns {a[0]} vs {b[0]}"
    x, y = set(a[1]), set(b[1])
    return False, f"rows {len(a[1])} vs {len(b[1])} cols={a[0]}\n   spark-only {sorted(x - y)[:3]}\n   sql-only   {sorted(y - x)[:3]}"


def main(argv):
    import __spark_entry__ as entry
    from tallymark.session import local_session
    sf = argv[argv.index("--sf") + 1] if "--sf" in argv else "0.01"
    parts = [a for i, a in enumerate(argv) if not a.startswith("--") and (i == 0 or argv[i - 1] != "--sf")]
    spark = local_session("oracle-check")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + name, note, flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
