"""Compare every registered query with its SQL oracle: columns, types, row count, values.

Usage: python tests/oracle.py [sf folder] [query name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(spark_type: str) -> str:
    return {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(
        spark_type, spark_type
    )


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty if the results agree."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rel = con.sql(sql)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if names != sorted(rel.columns):
        return [f"columns {names} vs {sorted(rel.columns)}"]
    out = [f"type of {c}: {types[c]} vs {duck_types[c]}" for c in names if kind(types[c]) != duck_types[c]]
    left = canonical([tuple(r[c] for c in names) for r in df.collect()])
    at = [rel.columns.index(c) for c in names]
    right = canonical([tuple(r[i] for i in at) for r in rel.fetchall()])
    if len(left) != len(right):
        out.append(f"rows {len(left)} vs {len(right)}")
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        out.append(f"{len(differing)} rows differ, first: {names} {differing[0][0]} vs {differing[0][1]}")
    if not left:
        out.append("no rows")
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from panelweave.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in args or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            problems = compare(df, con, sqls[name]) if name in sqls else ([] if df.count() else ["no rows"])
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in sqls else "ok (rows only)")
        print(f"{name:32s} {time.time() - t:6.2f}s {mark} {' | '.join(problems)}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
