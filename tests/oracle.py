"""Run registered queries against their SQL: ``python -m tests.oracle [folder] [name ...]``."""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, name, folder, queries, oracles):
    df = queries[name](spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), columns)
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    if got != want:
        extra, lost = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        raise AssertionError(f"{name}: {len(got)} rows, wanted {len(want)}; not wanted {[x[:300] for x in extra[:2]]}; missing {[x[:300] for x in lost[:2]]}")
    return len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from labelmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n = compare(spark, con, name, folder, queries(), oracle_sql())
            print(f"ok   {name:24} {n:7} rows {time.time() - start:6.2f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name:24} {str(e)[:1200]}", flush=True)
    sys.exit(bad > 0)
