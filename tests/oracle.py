"""Run a catalogue query on Spark and its SQL on DuckDB, and compare all rows.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    return str(value)


def difference(df, con, sql: str) -> str:
    """Empty when both give the same columns and the same bag of rows."""
    relation = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(relation.columns):
        return f"columns {columns} != {sorted(relation.columns)}"
    mine = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    order = [relation.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in relation.fetchall())
    if mine == theirs:
        return ""
    only_mine, only_theirs = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
    return (
        f"rows {sum(mine.values())} vs {sum(theirs.values())}, differing {sum((mine - theirs).values())}\n"
        f"  columns {columns}\n  spark {str(only_mine)[:700]}\n  duck  {str(only_theirs)[:700]}"
    )


def main() -> None:
    from plaudit import catalog
    from plaudit.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = difference(df, con, oracle[name]) or f"same ({df.count()} rows)"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            verdict = f"ERROR {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
