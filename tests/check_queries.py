"""Runs registered queries next to their SQL: python tests/check_queries.py SF_DIR [names...]"""

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, c, sf_dir, fn, sql):
    """(matches, spark rows, sql rows, message)"""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if sql is None:
        return True, sum(got.values()), None, "rows only"
    cur = c.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return False, sum(got.values()), None, f"columns {sorted(cols)} <> {names}"
    at = [cols.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return True, sum(got.values()), sum(want.values()), ""
    return False, sum(got.values()), sum(want.values()), (
        f"{names}\n  spark only {list((got - want).items())[:2]}\n  sql only   {list((want - got).items())[:2]}"
    )


def main():
    from __spark_entry__ import oracle_sql, queries

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    c, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            ok, a, b, why = compare(spark, c, sf_dir, fn, sqls.get(name))
        except Exception as e:
            ok, a, b, why = False, None, None, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {a} {b} {time.time() - t:.1f}s {why}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
