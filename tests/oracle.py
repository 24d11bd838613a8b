"""Run registered queries in Spark and their oracle SQL in DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE[]": "array<double>"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, tuple) else (False, "t", str(v)) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and an oracle result; empty when equal."""
    columns = sorted(df.columns)
    spark_rows = [tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    raw = cursor.fetchall()
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    order = [names.index(c) for c in columns]
    duck_rows = [tuple(plain(row[i]) for i in order) for row in raw]
    problems = []
    spark_types = dict(df.dtypes)
    for c in columns:
        if TYPES.get(duck_types[c], duck_types[c]) != spark_types[c]:
            problems.append(f"type of {c}: {spark_types[c]} != {duck_types[c]}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    a, b = sorted(spark_rows, key=sort_key), sorted(duck_rows, key=sort_key)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        problems.append(f"{len(different)} rows differ, columns {columns}, first {different[:2]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from cinderframe.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                problems = [] if rows else ["no rows"]
                if prefixes:
                    for row in rows[:12]:
                        print("   ", row)
            n = "" if problems else "ok"
        except Exception as error:  # report and go on with the next query
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(problems)
        print(f"{name:32s} {time.time() - start:6.1f}s {'S' if name in oracles else 'R'} {n} {'; '.join(problems)}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
