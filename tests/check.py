"""Compare registered queries with their DuckDB oracles: python tests/check.py [sf] [names...]"""
import sys, time, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb, pandas as pd
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = [None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA else
                  (round(float(v), 6) if isinstance(v, (float,)) else
                   (str(int(v)) if isinstance(v, (int,)) and not isinstance(v, bool) else str(v))) for v in pdf[c].astype(object)]
        pdf[c] = [str(v) for v in pdf[c]]
    return sorted(map(tuple, pdf.values.tolist()))


def connect(sf_dir):
    con = duckdb.connect(); con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir, inspect=None):
    t = time.time(); df = fn(spark, sf_dir)
    if inspect:
        inspect(name, df)
    got = df.toPandas(); dt = time.time() - t
    if sql is None:
        return f"{name}: rows-only {len(got)} ({dt:.1f}s)", len(got) > 0
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}", False
    a, b = norm(got), norm(want)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"{name}: DIFF rows {len(a)} vs {len(b)} cols {sorted(got.columns)}\n   spark-only {list(sa - sb)[:3]}\n"
                f"   duck-only {list(sb - sa)[:3]}"), False
    return f"{name}: ok {len(a)} ({dt:.1f}s)", len(a) > 0


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.conftest import make_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    spark = make_session(); con = connect(f"/root/testdata/sf{sf}")
    q, o = e.queries(), e.oracle_sql(); bad = 0
    for name, fn in q.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            msg, ok = compare(spark, con, name, fn, o.get(name), f"/root/testdata/sf{sf}")
        except Exception as ex:
            msg, ok = f"{name}: ERROR {str(ex)[:1500]}", False
        bad += not ok
        print(("" if ok else "!! ") + msg, flush=True)
    print("bad", bad)
    spark.stop()
