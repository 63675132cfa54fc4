"""Run queries beside their SQL and compare the results.

    python -m tests.parity [directory] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(directory) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} against {sorted(sql_columns)}"
    ours, theirs = _rows(spark_columns, spark_rows), _rows(sql_columns, sql_rows)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            return f"{a} against {b}"
    return None


def check(spark, con, directory: str, name: str, query, sql: str) -> tuple[str | None, int]:
    df = query(spark, directory)
    rows = df.collect()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return compare(df.columns, rows, columns, result.fetchall()), len(rows)


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from shelflot.session import build_session

    directory = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(oracles)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    failed = 0
    for name in wanted:
        began = time.time()
        try:
            found, n = check(spark, con, directory, name, queries[name], oracles[name])
        except Exception as error:  # keep going: this is a report
            found, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name:32} {n:7} rows {time.time() - began:6.2f}s {found or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
