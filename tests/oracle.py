"""Runs registered queries next to their SQL in DuckDB and reports differences.

    python tests/oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)  # -0.0 counts as 0.0
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ, first:\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main() -> None:
    from envspark.catalog import ORACLES, QUERIES
    from envspark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, fn, ORACLES[name])
                note = "ok"
            else:
                problem, note = None, f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - t:6.2f}s {problem or note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
