"""Compares registered queries with their SQL in DuckDB: `python -m tools.oracle [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from propflow.catalog import ORACLE, QUERIES
from propflow.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events"
    " documents embeddings pages benchmark labels conversations"
).split()

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _bag(rows: list, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when equal."""
    described = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    problems = []
    if spark_types != described:
        only = {k: (spark_types.get(k), described.get(k)) for k in {*spark_types, *described}}
        problems.append(f"schema {({k: v for k, v in only.items() if v[0] != v[1]})}")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _bag(result.fetchall(), names)
    ours = _bag(df.collect(), df.columns)
    if ours != theirs:
        extra, missing = list((ours - theirs).items()), list((theirs - ours).items())
        problems.append(
            f"rows {sum(ours.values())} against {sum(theirs.values())};"
            f" only here {len(extra)}: {str(extra[:2])[:400]}; only there {len(missing)}: {str(missing[:2])[:400]}"
        )
    return problems


def main(arguments: list[str]) -> int:
    sf = f"/root/testdata/{arguments[0] if arguments else 'sf0.01'}"
    names = arguments[1:] or list(QUERIES)
    spark, con = build_session(), connect(sf)
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf)
            problems = compare(df, con, ORACLE[name]) if name in ORACLE else [f"{df.count()} rows, no SQL"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", *problems, sep="\n     ")
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
