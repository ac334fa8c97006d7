"""Run queries in both engines and compare: ``python -m checks.compare [--sf 0.01] [name ...]``."""

import argparse
import math
import time

import duckdb

from checks.catalog import QUERIES
from checks.oracles import oracle_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if got != want:
        extra, lacking = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
        return f"{len(got)} rows instead of {len(want)}; {len(extra)} extra {extra[:2]}; {len(lacking)} lacking {lacking[:2]}"
    return "" if got else "no rows"


def main() -> None:
    from hexwarden.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in args.names or QUERIES:
        started = time.monotonic()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001  (a failing query is reported, the others still run)
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {time.monotonic() - started:6.2f}s {problem}", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")


if __name__ == "__main__":
    main()
