"""Compares driver queries with their SQL on DuckDB: python tests/oracle_check.py [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("riskloom-check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return "ROWS", len(got[1]), took, "", df.dtypes
    cur = con.execute(sql)
    names, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got == want:
        return "OK" if got[1] else "EMPTY", len(got[1]), took, "", (df.dtypes, list(zip(names, types)))
    why = f"columns {got[0]} vs {want[0]}" if got[0] != want[0] else ""
    a, b = set(got[1]), set(want[1])
    why += f" rows {len(got[1])} vs {len(want[1])}\n   spark only: {sorted(a - b)[:2]}\n   sql only:   {sorted(b - a)[:2]}"
    return "DIFF", len(got[1]), took, why, None


def main():
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name in qs:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            status, n, took, why, types = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            status, n, took, why, types = "FAIL", 0, 0.0, f"{type(err).__name__}: {str(err)[:1500]}", None
        bad += status in ("DIFF", "FAIL", "EMPTY")
        print(f"{status:5} {name:28} {n:7d} rows {took:6.2f}s {why}", flush=True)
        if status == "OK" and os.environ.get("TYPES"):
            print("      ", types)
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
