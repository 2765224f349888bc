"""Runs a registered query beside its DuckDB SQL and compares the rows as bags.

    python tests/compare.py [--sf DIR] NAME ...
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql, sf_dir):
    """(rows of the query, rows of the SQL, up to three rows of each that the other lacks)."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    ours, names = [tuple(r) for r in df.collect()], df.columns
    res = con.sql(sql)
    theirs, other = res.fetchall(), res.columns
    assert sorted(names) == sorted(other), (sorted(names), sorted(other))
    a, b = _bag(ours, names), _bag(theirs, other)
    sa, sb = set(map(repr, a)), set(map(repr, b))
    only_a, only_b = [x for x in a if repr(x) not in sb][:3], [x for x in b if repr(x) not in sa][:3]
    return len(a), len(b), only_a, only_b, [repr(x) for x in a] == [repr(x) for x in b]


def main(args):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), []
    for name in args or queries:
        t = time.time()
        try:
            if name in sql:
                n, m, x, y, same = differences(spark, queries[name], sql[name], sf)
                print(f"{name}: {'same' if same else 'DIFFERS'} {n} {m} rows, {time.time() - t:.1f} s", flush=True)
                if not same:
                    bad.append(name)
                    for r in x:
                        print("   only ours:  ", str(r)[:600])
                    for r in y:
                        print("   only theirs:", str(r)[:600])
            else:
                print(f"{name}: {queries[name](spark, sf).count()} rows, no SQL, {time.time() - t:.1f} s", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
