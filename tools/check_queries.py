"""Run the named queries in Spark and their SQL twins in DuckDB and compare the rows.

Usage: python tools/check_queries.py [--sf 0.01] [--exact] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time


sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagelake.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from pagelake.session import local_session  # noqa: E402

EXACT = "--exact" in sys.argv  # compare doubles bit by bit instead of to nine digits

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """A comparable form: floats to 9 significant digits, nested rows to tuples."""
    if isinstance(value, float):
        return None if math.isnan(value) else (value if EXACT else float(f"{value:.9g}")) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return "rows-only", f"{len(ours)} rows"
    relation = con.execute(ORACLES[name])
    columns = [d[0] for d in relation.description]
    theirs = rows_of(columns, relation.fetchall())
    if sorted(df.columns) != sorted(columns):
        return "FAIL", f"columns {sorted(df.columns)} against {sorted(columns)}"
    if ours == theirs:
        return "ok", f"{len(ours)} rows"
    only_a, only_b = list(set(ours) - set(theirs))[:3], list(set(theirs) - set(ours))[:3]
    return "FAIL", f"{len(ours)} against {len(theirs)} rows\n  only Spark: {only_a}\n  only SQL:   {only_b}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--exact", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            state, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the other queries
            state, note = "ERROR", str(error)[:1500]
        bad += state in ("FAIL", "ERROR")
        print(f"{state:9s} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
