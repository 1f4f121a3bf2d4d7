"""Run queries against their SQL in DuckDB: python tests/compare.py ROOT [NAME or PREFIX* ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """'' if both have the same rows, else what differs."""
    relation = con.sql(sql)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} and {sorted(relation.columns)}"
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}, only SQL {sorted(b - a)[:3]}"


def main() -> None:
    import __spark_entry__ as entry
    from quillstone.session import session

    root, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(root)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, f in queries.items():
        if wanted and not any(name == w or w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        began = time.time()
        try:
            said = difference(f(spark, root), con, sql[name]) if name in sql else f"- no SQL, {f(spark, root).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("-")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main()
