"""Run every registered query and its SQL twin side by side.

usage: python tests/compare.py [sf] [name-part ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for rec in df.itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                row.append("<null>")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                row.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype") and v.ndim == 0 and v.dtype.kind in "iuf":
                row.append(repr(float(v)))
            elif hasattr(v, "__iter__") and not isinstance(v, str):
                row.append(str([x for x in v]))
            else:
                row.append(str(pd.Timestamp(v)) if hasattr(v, "year") else str(v))
        rows.append(tuple(row))
    return sorted(rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.toPandas()
    if sql is None:
        return ("ROWS", len(got), "") if len(got) else ("EMPTY", 0, "")
    rel = con.execute(sql)
    want = rel.fetch_df() if hasattr(rel, "fetch_df") else rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return "COLUMNS", len(got), f"{sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ("OK" if len(a) else "EMPTY"), len(a), ""
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return "DIFF", len(a), f"{len(a)} vs {len(b)} rows; cols {sorted(got.columns)}; first {str(diff)[:1500]}"


def main():
    import __spark_entry__ as entry
    from cutline.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            status, n, note = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, n, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:1200]}"
        print(f"{status:8s} {name:40s} {n:8d} rows {time.time() - t:6.1f}s {note}", flush=True)
        if status not in ("OK", "ROWS"):
            bad.append(name)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
