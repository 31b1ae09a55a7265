"""Run registered queries against their check SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, datetime.date, datetime.datetime)):
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", float(v))
    if isinstance(v, float):
        return float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return repr(v)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


check_seconds = 0.0


def compare(df, con, sql):
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    start = time.time()
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    global check_seconds
    check_seconds = time.time() - start
    problems = []
    if sorted(got_cols) != sorted(rel.columns):
        problems.append(f"columns {sorted(got_cols)} != {sorted(rel.columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_got, only_want = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        problems.append(f"\n   spark only {only_got}\n   check only {only_want}")
    return len(got), problems


def main() -> int:
    import __spark_entry__ as entry
    from curatorium.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    names = args[1:] or list(entry.queries())
    spark = local_session(8, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, bad = duck(sf_dir), 0
    queries, checks = entry.queries(), entry.oracle_sql()
    for name in names:
        start = time.time()
        globals()["check_seconds"] = 0.0
        try:
            df = queries[name](spark, sf_dir)
            if name in checks:
                n, problems = compare(df, con, checks[name])
            else:
                n, problems = df.count(), []
            tag = "ok  " if not problems else "BAD "
        except Exception as e:  # noqa: BLE001
            n, problems, tag = -1, [f"{type(e).__name__}: {str(e)[:700]}"], "ERR "
        bad += bool(problems)
        kind = "O" if name in checks else "R"
        print(f"{tag}{kind} {name:22s} rows={n:7d} {time.time() - start:6.2f}s (check {check_seconds:.1f}s) {' '.join(problems)}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
