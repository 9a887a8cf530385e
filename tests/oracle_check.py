"""Compare registered queries with their SQL twins.

    python tests/oracle_check.py [--sf 0.01] [name or prefix* ...]
"""

import argparse
import fnmatch
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from voxframe.plans.fixtures import TABLES  # noqa: E402


def kind(t):
    t = str(t).upper()
    for a, b in (("DECIMAL", "DECIMAL"), ("DOUBLE", "DOUBLE"), ("FLOAT", "FLOAT"), ("BIGINT", "BIGINT"),
                 ("HUGEINT", "HUGEINT"), ("INT", "INT"), ("VARCHAR", "STRING"), ("STRING", "STRING"),
                 ("BOOL", "BOOL"), ("TIMESTAMP", "TIMESTAMP")):
        if t.startswith(a):
            return b
    return t


def compare(df, con, sql):
    t0 = time.time()
    mine = df.toPandas()
    t1 = time.time()
    rel = con.sql(sql)
    dtypes = dict(zip(rel.columns, rel.types))
    theirs = rel.df()
    took = f"[spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s]"
    order = sorted(df.columns)
    if order != sorted(dtypes):
        return False, f"columns {order} != {sorted(dtypes)}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}; spark {mine[order].head(2).values} sql {theirs[order].head(2).values}"
    types = [f"{c}: spark {t} sql {dtypes[c]}" for c, t in df.dtypes if kind(t) != kind(dtypes[c])]

    def canon(pdf):
        pdf = pdf[order].copy()
        for c in order:
            if pdf[c].dtype.kind == "f":
                pdf[c] = pdf[c] + 0.0
            elif pdf[c].dtype.kind not in "iub":
                pdf[c] = pdf[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v else str(v))
        return pdf.sort_values(order, kind="stable").reset_index(drop=True)

    a, b = canon(mine), canon(theirs)
    bad = None
    for c in order:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            x, y = x.astype(float), y.astype(float)
        diff = ~((x == y) | (x.isna() & y.isna()))
        bad = diff if bad is None else bad | diff
    if bad.any():
        i = bad[bad].index[:3]
        return False, f"{int(bad.sum())} of {len(a)} rows differ {took}, cols {order}: {a.loc[i].values.tolist()} / {b.loc[i].values.tolist()}"
    if types:
        return False, f"types: {types}"
    return True, f"{len(a)} rows {took}"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from voxframe.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("8", **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(fnmatch.fnmatch(n, p) for p in args.names)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in sqls:
                ok, msg = compare(df, con, sqls[n])
            else:
                ok, msg = True, f"{len(df.collect())} rows, no sql"
        except Exception as e:
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time()-t0:.1f}s {msg}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
