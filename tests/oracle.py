"""Compare a registered query with its SQL on the same tables.

Run ``python -m tests.oracle [sf] [name ...]`` for a report with timings.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(repr(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) else (False, "n", v) for v in row)


def _family(name: str) -> str:
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "int"
    if name in ("float", "double", "real"):
        return "float"
    if name.startswith(("string", "varchar")):
        return "text"
    if name.startswith("timestamp"):
        return "time"
    return name.split("(")[0].split("<")[0]


def differences(df, con, sql: str) -> str | None:
    """None when columns, column types, and the multiset of rows agree; else what differs."""
    cols = sorted(df.columns)
    rows = [tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    found = con.execute(sql)
    names = [(d[0], str(d[1])) for d in found.description]
    if sorted(n for n, _ in names) != cols:
        return f"columns {cols} != {sorted(n for n, _ in names)}"
    types = {n: _family(t) for n, t in names}
    for field in df.schema.fields:
        if _family(field.dataType.simpleString()) != types[field.name] and "list" not in types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} != {dict(names)[field.name]}"
    order = [[n for n, _ in names].index(c) for c in cols]
    expect = [tuple(_plain(r[i]) for i in order) for r in found.fetchall()]
    if len(rows) != len(expect):
        return f"{len(rows)} rows != {len(expect)}"
    rows.sort(key=_key)
    expect.sort(key=_key)
    for got, want in zip(rows, expect, strict=True):
        if got != want:
            return f"row {got} != {want}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from flowlens.session import build_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    runs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in runs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                problem = differences(df, con, sqls[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as err:  # the report goes on with the next query
            problem = "".join(traceback.format_exception_only(err))[:1500]
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
