"""Run registered queries on Spark and their SQL checks on DuckDB and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    except ValueError:
        return False


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (status, message)."""
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    t1 = time.time() - t
    if sql is None:
        return ("rows", f"{len(left)} rows, no check, {t1:.1f}s")
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    t2 = time.time() - t
    if sorted(names) != cols:
        return ("FAIL", f"columns {cols} vs {sorted(names)}")
    idx = [names.index(c) for c in cols]
    right = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    if left == right:
        return ("ok", f"{len(left)} rows, {t1:.1f}s / {t2:.1f}s")
    only_l = [r for r in left if r not in set(right)]
    only_r = [r for r in right if r not in set(left)]
    near = len(left) == len(right) and all(
        len(a) == len(b) and all(close(x, y) for x, y in zip(a, b)) for a, b in zip(left, right))
    return ("NEAR" if near else "FAIL",
            f"{len(left)} vs {len(right)} rows, {len(only_l)}/{len(only_r)} differ, {t1:.1f}s\n   "
            f"cols  {cols}\n   spark {only_l[:3]}\n   duck  {only_r[:3]}")


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    checks = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, msg = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as e:  # report and go on
            status, msg = "ERROR", str(e)[:1500]
        print(f"{status:5s} {name}: {msg}", flush=True)
        if status not in ("ok", "rows"):
            bad.append(name)
    print("BAD", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
