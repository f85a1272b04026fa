"""Compare a registered query with its DuckDB twin: columns, row count and values, in any row order."""

import datetime
import decimal
import math

import duckdb

from workloads.derived import GIVEN


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else float(f"{value:.10g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, build, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = build(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}: only ours {[r for r in ours if r not in set(theirs)][:3]}, only theirs {[r for r in theirs if r not in set(ours)][:3]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}"
    if not ours:
        return "no rows"
    return None
