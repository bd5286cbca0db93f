"""Runs registered queries against their SQL in DuckDB and compares rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, folder: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return True, f"{len(got)} rows"
    return False, f"{len(got)} vs {len(want)} rows; only spark {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}; diff {sum((a-b).values())}"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = "/root/testdata/sf0.01"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [a for a in sys.argv[1:] if not a.startswith("@")]
    modules = [a[1:] for a in sys.argv[1:] if a.startswith("@")]
    bad = 0
    for name, fn in queries.items():
        chosen = any(w in name for w in wanted) or entry.module_of(name) in modules
        if (wanted or modules) and not chosen:
            continue
        t0 = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, folder, fn, oracles[name])
            else:
                n = len(fn(spark, folder).collect())
                ok, note = n > 0, f"no sql, {n} rows"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__} {str(e)[:500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {note}".replace("\n", " ")[:900], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
