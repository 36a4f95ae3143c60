"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else ("nan" if math.isnan(v) else v)
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    mine = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = _sorted(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from tierblend.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                          "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = database(sf), e.oracle_sql()
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                result = difference(df, con, sqls[name]) or "equal"
            else:
                result = f"rows {len(df.collect())}"
        except Exception as x:  # report and go on
            result = f"FAILED {type(x).__name__}: {str(x)[:600]}"
        print(f"{name:28s} {time.time() - t:7.2f}s  {result}", flush=True)
