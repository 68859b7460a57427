"""Compare registered queries with their SQL oracle.

    python tests/oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import decimal
import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terravet.catalog.registry import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


SPARK_KIND = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float",
              "double": "double", "string": "str", "boolean": "bool", "date": "date",
              "timestamp": "ts", "timestamp_ntz": "ts"}
DUCK_KIND = {"INTEGER": "int", "BIGINT": "long", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "str",
             "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts", "HUGEINT": "huge"}


def compare(spark_df, con, sql: str) -> list[str]:
    cols = sorted(spark_df.columns)
    kinds = dict(spark_df.dtypes)
    got = [tuple(norm(r[c]) for c in cols) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    problems = []
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"]
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    for c in cols:
        a, b = SPARK_KIND.get(kinds[c], kinds[c]), DUCK_KIND.get(types[c], types[c])
        if a != b:
            problems.append(f"type {c}: {kinds[c]} vs {types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got.sort(key=key), want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} of {len(got)} rows differ, e.g. {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}")
    if not got:
        problems.append("EMPTY result")
    return problems


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    from terravet.session import build_session
    import __spark_entry__ as contract
    spark = build_session("oracle", "local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if parts and not any(p in name or p == contract.load_entries()[name].survey
                             or p == sys.modules[contract.load_entries()[name].build.__module__].__name__.split(".")[-1]
                             for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problems = [] if n else ["EMPTY result"]
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        took = time.time() - start
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in oracles else "rows")
        if problems or took > 4 or os.environ.get("VERBOSE"):
            print(f"{mark} {name} {took:.1f}s", *problems, sep="\n  " if problems else " ", flush=True)
    print(f"checked, {failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    raise SystemExit(bool(main(sys.argv[1:])))
