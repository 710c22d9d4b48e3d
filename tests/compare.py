"""Compare registered queries with their SQL: python -m tests.compare <folder> [names...]"""

import glob
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


def difference(spark, con, folder, build, sql):
    """None if equal, else a short text."""
    df = build(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from klaxon.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    built, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(built) - set(sql)), "without query:", sorted(set(sql) - set(built)))
    bad = 0
    for name in names or built:
        start = time.time()
        try:
            problem = difference(spark, con, folder, built[name], sql[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
