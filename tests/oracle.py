"""Side-by-side run of a registered query and its SQL in DuckDB.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    return names, Counter(tuple(_plain(v) for v in row) for row in rows)


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    rows = cursor.fetchall()
    return [found[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sf_dir: str) -> str | None:
    names, ours = spark_rows(query.run(spark, sf_dir))
    if query.sql is None:
        return None
    columns, theirs = sql_rows(con, query.sql)
    if names != columns:
        return f"columns {names} vs {columns}"
    if ours != theirs:
        left, right = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only spark {left}; only sql {right}"
    return None


def main() -> None:
    from wardlens.catalog import load
    from wardlens.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, query in load().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            problem = difference(spark, con, query, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "rows-only" if query.sql is None else "ok"
        print(f"{'FAIL' if problem else kind:10}{name:36}{time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failed", failed)
    spark.stop()


if __name__ == "__main__":
    main()
