"""Audits of incoming rows against brute force, and appends that break what the destination declares."""

import random
from collections import Counter

import pytest

from tests.test_runs import ROW, numbers
from tidemark.operators import rowaudit
from tidemark.operators.load import load
from tidemark.operators.rowaudit import Declared, Incoming
from tidemark.plans.migration import TableMove, run_migration

SCHEMA = "id bigint, part string, amount double, word string"


def rows_of(seed: int, n: int):
    rng = random.Random(seed)
    return [(rng.choice([None, 7, 7, rng.randrange(60), 40_000]), rng.choice([None, "", "a", "b"]), rng.choice([None, 1.0, 2.5, 1e12]),
             rng.choice([None, "", "abc", "abcdef", "é" * 4])) for _ in range(n)]


def test_columns_and_keys_against_brute_force(spark):
    new, old = rows_of(1, 300), rows_of(2, 200)
    table = Incoming(
        "public.t", spark.createDataFrame(new, SCHEMA),
        [Declared("id", "smallint", False), Declared("amount", "integer", False), Declared("word", "varchar(4)", False),
         Declared("part", "tsvector", False), Declared("absent", "text", False)],
        ("id", "part"), spark.createDataFrame(old, SCHEMA))
    got = {r["column_name"]: tuple(r)[3:] for r in rowaudit.column_audits([table]).collect()}
    assert got == {
        "id": (sum(r[0] is None for r in new), 0, sum(r[0] == 40_000 for r in new), 0),
        "amount": (sum(r[2] is None for r in new), 0, sum(r[2] == 1e12 for r in new), sum(r[2] == 2.5 for r in new)),
        "word": (sum(r[3] is None for r in new), sum(len(r[3] or "") > 4 for r in new), 0, 0),
        "part": (sum(r[1] is None for r in new), 0, None, None)}
    keys = Counter((r[0], r[1]) for r in new if r[0] is not None and r[1] is not None)
    met = {(r[0], r[1]) for r in old}
    (found,) = rowaudit.key_audits([table]).collect()
    assert tuple(found) == ("public.t", "id, part", 300 - sum(keys.values()), sum(n > 1 for n in keys.values()), sum(k in met for k in keys))


def test_many_tables_meet_in_one_shuffle_and_empty_ones_have_a_line(spark):
    tables = [Incoming(f"t{i}", numbers(spark, i * 3), [Declared("id", "bigint", False)], ("id",), numbers(spark, 2)) for i in range(4)]
    found = rowaudit.key_audits(tables)
    assert sorted((r["table_name"], r["duplicate_keys"], r["colliding_keys"]) for r in found.collect()) == [
        ("t0", 0, 0), ("t1", 0, 2), ("t2", 0, 2), ("t3", 0, 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") <= 4 and "SortMergeJoin" not in plan
    assert rowaudit.column_audits(tables[:1]).collect()[0]["null_rows"] == 0
    assert rowaudit.key_audits([Incoming("none", numbers(spark, 1))]).collect() == []
    assert rowaudit.row_findings([Incoming("none", numbers(spark, 1))]).collect() == []


def test_a_catalog_gives_columns_in_order_and_the_key(spark):
    catalog = spark.createDataFrame(
        [("a.t", 1, "b", "text", None, None, None), ("a.t", 0, "a", "bigint", False, True, False), ("a.t", 2, "g", "text", True, False, True),
         ("a.u", 0, "x", "text", True, False, False)],
        "qn string, pos int, name string, native_type string, nullable boolean, is_pk boolean, is_generated boolean")
    assert rowaudit.declared_columns(catalog, ["a.t", "a.none"]) == {
        "a.t": ((Declared("a", "bigint", False), Declared("b", "text", True)), ("a",))}


def test_an_append_with_colliding_keys_is_refused_unless_allowed(spark, tmp_path):
    dest = f"{tmp_path}/t"
    numbers(spark, 10).write.parquet(dest)
    with pytest.raises(RuntimeError, match=r"public.t: 4 key\(s\) of \(id\) are in the destination"):
        load(numbers(spark, 6, 6), dest, "append", "public.t", key=("id",))
    twice = numbers(spark, 3, 50).union(numbers(spark, 1, 50))
    with pytest.raises(RuntimeError, match="1 key.* occur more than once"):
        load(twice, dest, "append", "public.t", key=("id",))
    assert spark.read.parquet(dest).count() == 10
    assert load(numbers(spark, 6, 6), dest, "append", "public.t", key=("id",), allow_collisions=True).rows_written == 6
    assert load(numbers(spark, 3, 90), dest, "append", "public.t", key=("id",)).rows_written == 3
    assert load(numbers(spark, 3, 5), f"{tmp_path}/new", "append", key=("id",)).rows_written == 3


@pytest.mark.parametrize("mode", ["append", "truncate", "abort"])
def test_rows_without_a_needed_value_are_refused(spark, tmp_path, mode):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    with pytest.raises(RuntimeError, match=r"1 row\(s\) have no value for v"):
        load(rows, f"{tmp_path}/t", mode, "public.t", not_null=("id", "v"))
    load(rows, f"{tmp_path}/t", mode, "public.t", not_null=("id",))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_a_run_reports_what_was_refused(spark, tmp_path):
    for name in ("a", "b", "c"):
        numbers(spark, 10).write.parquet(f"{tmp_path}/{name}")
    nulls = spark.createDataFrame([(1, None)], "id bigint, v string")
    moves = [
        TableMove("s.a", "d.a", numbers(spark, 3), f"{tmp_path}/a", ROW, "append", "count_only", ("id",)),
        TableMove("s.b", "d.b", numbers(spark, 3), f"{tmp_path}/b", ROW, "append", "count_only", ("id",), allow_collisions=True),
        TableMove("s.c", "d.c", nulls, f"{tmp_path}/c", ROW, "truncate", "count_only", ("id",), not_null=("v",))]
    _, tables, _ = run_migration(moves)
    got = {r["source_table"]: r for r in tables.collect()}
    assert "are in the destination already" in got["s.a"]["error"] and got["s.a"]["rows_written"] is None
    assert got["s.b"]["rows_written"] == 3
    assert "NOT NULL" in got["s.c"]["error"]
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in "abc"] == [10, 13, 10]
