"""Runs queries against their SQL: python tests/oracle_check.py sf_dir [name...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([tuple(str(r[k]) for k in order) for r in rows])


def compare(spark, query, sql, sf_dir):
    """None if both give the same, else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only in Spark {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name not in sqls:
            continue
        t = time.time()
        try:
            found = compare(spark, query, sqls[name], sys.argv[1])
        except Exception as e:  # one report line for each query
            found = str(e)[:400]
        print(name, "ok" if found is None else f"DIFFERS {found}", f"{time.time() - t:.1f}s", flush=True)
