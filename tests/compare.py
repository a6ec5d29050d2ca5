"""Run registered queries and their checking SQL side by side.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if ours else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return None
    mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
    return (
        f"{len(ours)} and {len(theirs)} rows; only ours {sorted(mine)[:2]}; "
        f"only theirs {sorted(other)[:2]}"
    )


def main():
    import __spark_entry__ as entry
    from graphloom.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, entry.oracle_sql().get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:24} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} queries differ")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
