"""Run registered queries beside their SQL twins and compare all values.

    python tests/compare.py [name ...] [--sf DIR]
"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{round(value, 9) + 0.0:.9f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows", len(mine)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normal(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}: {mine[:2]} vs {theirs[:2]}", len(mine)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0]}", len(mine)
    return None, len(mine)


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    import __spark_entry__ as contract

    from featurelens.session import build_session

    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = [n for n in queries if not args or any(n == a or n.startswith(a + ":") for a in args)]
    bad = []
    for name in names:
        started = time.time()
        try:
            problem, rows = compare(spark, con, queries[name], oracles.get(name), sf)
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", 0
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind:4} {time.time() - started:6.2f}s {rows:7} {name}"
              + (f"\n      {problem}" if problem else ""), flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
