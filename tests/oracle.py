"""Compare registered queries with their SQL in DuckDB: `python tests/oracle.py <folder> [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cueloom.plans.roles import TABLES  # noqa: E402

SIMPLE = {"BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "HUGEINT": "huge", "DOUBLE": "float",
          "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
SPARK = {"bigint": "int", "int": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def compare(spark, con, folder: str, build, sql: str) -> tuple[int, str | None]:
    got = build(spark, folder)
    rows = got.collect()
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    kinds = {d[0]: SIMPLE.get(str(d[1]).split("(")[0], str(d[1])) for d in want.description}
    if sorted(cols) != sorted(got.columns):
        return len(rows), f"columns {sorted(got.columns)} vs {sorted(cols)}"
    mine = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in got.schema.fields}
    names = sorted(cols)
    odd = [(n, mine[n], kinds[n]) for n in names if mine[n] != kinds[n]]
    at = [cols.index(n) for n in names]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in want.fetchall())
    ours = sorted(tuple(_cell(r[n]) for n in names) for r in rows)
    if len(ours) != len(theirs):
        return len(rows), f"rows {len(ours)} vs {len(theirs)}"
    if ours != theirs:
        only = sorted(set(ours) - set(theirs))[:3]
        other = sorted(set(theirs) - set(ours))[:3]
        return len(rows), f"values {names}\n   spark {only}\n   check {other}\n   types {odd}"
    if odd:
        return len(rows), f"types {odd}"
    return len(rows), None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from cueloom.session import local_session

    spark = local_session(8)
    con = connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in checks:
                n, problem = compare(spark, con, folder, queries[name], checks[name])
            else:
                n, problem = queries[name](spark, folder).count(), None
        except Exception as exc:  # report and go on
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:900]}"
        mark = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        tag = "" if name in checks else " (rows only)"
        if problem is not None or n == 0 or time.time() - start > 4 or names:
            print(f"{mark} {name}{tag} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failing of {len(queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
