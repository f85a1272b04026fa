"""Audits of the rows that a plan would load, by what the destination's catalog declares about them.

Every table is read once for all of its columns, and the keys of all tables meet in one aggregation.
"""

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.canon import row_hash
from tidemark.functions.casts import pg_cast
from tidemark.functions.text import quoted, thousands
from tidemark.operators.keyed import union_all

_LENGTH = re.compile(r"\s*(?:character varying|varchar|character|char|bpchar)\s*\(\s*(\d+)\s*\)\s*", re.IGNORECASE)

#: Severity and message by code.
ROW_FINDINGS = {
    "preflight.null_values": ("error", "%s: %s row(s) have no value for %s, which the destination declares NOT NULL."),
    "preflight.values_too_long": ("error", "%s: %s value(s) of %s are longer than %s allows."),
    "preflight.values_rejected": ("error", "%s: %s value(s) of %s cannot be cast to %s."),
    "preflight.values_changed": ("warning", "%s: %s value(s) of %s change when cast to %s."),
    "preflight.duplicate_keys": ("error", "%s: %s key(s) of (%s) occur more than once in the incoming rows."),
    "preflight.null_keys": ("error", "%s: %s row(s) have no whole key (%s)."),
    "preflight.key_collisions": ("error", "%s: %s key(s) of (%s) are in the destination already; appending would double them."),
}


@dataclass(frozen=True)
class Declared:
    """A destination column as its catalog describes it."""

    name: str
    native_type: str
    nullable: bool = True


@dataclass(frozen=True)
class Incoming:
    """Rows on their way to one destination table: its column names, values not cast yet.

    ``present`` are the destination's rows where the load keeps them; without it no key can collide.
    """

    table: str
    rows: DataFrame = field(repr=False)
    declared: Sequence[Declared] = ()
    key: Sequence[str] = ()
    present: DataFrame | None = field(default=None, repr=False)


def declared_columns(catalog: DataFrame, tables: Sequence[str]) -> dict[str, tuple[tuple[Declared, ...], tuple[str, ...]]]:
    """(columns that a load writes, key columns) of each of the given tables, by one aggregation over the catalog's columns.

    Generated columns are left out, as no load writes them. Tables that the catalog lacks have no entry.
    """
    one = F.struct("pos", "name", "native_type", F.coalesce("nullable", F.lit(True)).alias("nullable"), F.coalesce("is_pk", F.lit(False)).alias("is_pk"))
    chosen = catalog.filter(F.col("qn").isin(list(tables))).filter(~F.coalesce("is_generated", F.lit(False)))
    rows = chosen.groupBy("qn").agg(F.array_sort(F.collect_list(one)).alias("columns")).collect()
    return {r["qn"]: (
        tuple(Declared(c["name"], c["native_type"], c["nullable"]) for c in r["columns"]),
        tuple(c["name"] for c in r["columns"] if c["is_pk"])) for r in rows}


def length_limit(native_type: str) -> int | None:
    """n of varchar(n) and char(n), else null."""
    found = _LENGTH.fullmatch(native_type)
    return int(found.group(1)) if found else None


def _safe_cast(column: Declared, source: T.DataType) -> Column | None:
    """The value as the destination would hold it, null where it would be refused; none for types that have no cast here."""
    try:
        return pg_cast(quoted(column.name), source, column.native_type, safe=True)
    except (ValueError, TypeError, NotImplementedError):
        return None


def column_audits(tables: Sequence[Incoming]) -> DataFrame:
    """table_name, column_name, dest_type, null_rows, too_long_rows, rejected_rows, changed_rows; one pass per table.

    Null rows count where the destination declares NOT NULL. Texts longer than varchar(n) or char(n) are too long and count
    neither as rejected nor as changed. A value is rejected when the cast to the declared type fails and changed when the way back
    gives another value; both are null for types without a cast. Declared columns that the rows lack are left out.
    """
    return union_all([_column_audit(t) for t in tables])


def _column_audit(t: Incoming) -> DataFrame:
    types = {f.name: f.dataType for f in t.rows.schema.fields}
    columns = [c for c in t.declared if c.name in types]
    casts = {i: cast for i, c in enumerate(columns) if length_limit(c.native_type) is None
             and (cast := _safe_cast(c, types[c.name])) is not None}
    # each cast is projected once, then compared and counted
    rows = t.rows.select(*[quoted(c.name).alias(f"_s{i}") for i, c in enumerate(columns)], *[x.alias(f"_t{i}") for i, x in casts.items()])
    rows = rows.select("*", *[F.col(f"_t{i}").try_cast(types[columns[i].name]).alias(f"_b{i}") for i in casts])
    counts = []
    for i, c in enumerate(columns):
        limit = length_limit(c.native_type)
        text = isinstance(types[c.name], T.StringType)
        counts += [
            (F.lit(0) if c.nullable else F.count_if(F.col(f"_s{i}").isNull())).alias(f"_n{i}"),
            (F.count_if(F.length(f"_s{i}") > limit) if limit is not None and text else F.lit(0)).alias(f"_l{i}")]
        if i in casts:
            counts += [F.count_if(F.col(f"_s{i}").isNotNull() & F.col(f"_t{i}").isNull()).alias(f"_r{i}"),
                       F.count_if(F.col(f"_s{i}").isNotNull() & F.col(f"_t{i}").isNotNull()
                                  & ~F.col(f"_b{i}").eqNullSafe(F.col(f"_s{i}"))).alias(f"_c{i}")]
    totals = rows.agg(F.count(F.lit(1)).alias("_rows"), *counts)

    def entry(i: int, c: Declared) -> Column:
        known = i in casts or (length_limit(c.native_type) is not None and isinstance(types[c.name], T.StringType))
        none = F.lit(0) if known else F.lit(None)
        return F.struct(
            F.lit(t.table).alias("table_name"), F.lit(c.name).alias("column_name"), F.lit(c.native_type).alias("dest_type"),
            F.col(f"_n{i}").cast("bigint").alias("null_rows"), F.col(f"_l{i}").cast("bigint").alias("too_long_rows"),
            (F.col(f"_r{i}") if i in casts else none).cast("bigint").alias("rejected_rows"),
            (F.col(f"_c{i}") if i in casts else none).cast("bigint").alias("changed_rows"))

    empty = ("cast(array() as array<struct<table_name:string,column_name:string,dest_type:string,null_rows:bigint,too_long_rows:bigint,"
             "rejected_rows:bigint,changed_rows:bigint>>)")
    return totals.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)]) if columns else F.expr(empty)))


def key_audits(tables: Sequence[Incoming]) -> DataFrame:
    """table_name, null_keys, duplicate_keys, colliding_keys of every table with a key; one shuffle for all of them.

    Keys are compared by the md5 of their canonical text. Each task counts its own first, so a key that holds a third of a
    table, and rows without a whole key, arrive as one row per task. As under UNIQUE a key with a null never clashes.
    """
    keyed = [t for t in tables if t.key]

    def side(number: int, t: Incoming, df: DataFrame, incoming: int) -> DataFrame:
        whole = F.lit(True)
        for k in t.key:
            whole = whole & quoted(k).isNotNull()
        return df.select(
            F.lit(number).alias("table"), F.when(whole, row_hash(df, t.key)).alias("key"),
            F.lit(incoming).cast("bigint").alias("incoming"), F.lit(1 - incoming).cast("bigint").alias("present"))

    if not keyed:
        return tables[0].rows.sparkSession.createDataFrame(
            [], "table_name string, key_columns string, null_keys bigint, duplicate_keys bigint, colliding_keys bigint")
    sides = [side(i, t, t.rows.select(*[quoted(k) for k in t.key]), 1) for i, t in enumerate(keyed)]
    sides += [side(i, t, t.present.select(*[quoted(k) for k in t.key]), 0) for i, t in enumerate(keyed) if t.present is not None]
    # a table without any row still has its line
    spark = keyed[0].rows.sparkSession
    names = spark.createDataFrame([(i, t.table, ", ".join(t.key)) for i, t in enumerate(keyed)], "table int, table_name string, key_columns string")
    counts = union_all(sides).groupBy("table", "key").agg(F.sum("incoming").alias("incoming"), F.sum("present").alias("present"))
    verdicts = counts.groupBy("table").agg(
        F.sum(F.when(F.col("key").isNull(), F.col("incoming")).otherwise(0)).alias("null_keys"),
        F.count_if(F.col("key").isNotNull() & (F.col("incoming") > 1)).alias("duplicate_keys"),
        F.count_if(F.col("key").isNotNull() & (F.col("incoming") > 0) & (F.col("present") > 0)).alias("colliding_keys"))
    found = names.join(verdicts, "table", "left")
    return found.select("table_name", "key_columns", *[
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("null_keys", "duplicate_keys", "colliding_keys")])


def row_findings(tables: Sequence[Incoming]) -> DataFrame:
    """severity, code, message and target of everything that column_audits and key_audits find."""
    table = F.col("table_name")

    def entry(code: str, count: str, *values: Column, target: Column) -> Column:
        severity, template = ROW_FINDINGS[code]
        return F.when(F.col(count) > 0, F.struct(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"),
            F.format_string(template, table, thousands(F.col(count)), *values).alias("message"), target.alias("target")))

    column, kind = F.col("column_name"), F.col("dest_type")
    at = F.concat(F.lit("column:"), table, F.lit("."), column)
    columns = F.array_compact(F.array(
        entry("preflight.null_values", "null_rows", column, target=at),
        entry("preflight.values_too_long", "too_long_rows", column, kind, target=at),
        entry("preflight.values_rejected", "rejected_rows", column, kind, target=at),
        entry("preflight.values_changed", "changed_rows", column, kind, target=at)))
    key, whole = F.col("key_columns"), F.concat(F.lit("table:"), table)
    keys = F.array_compact(F.array(
        entry("preflight.null_keys", "null_keys", key, target=whole),
        entry("preflight.duplicate_keys", "duplicate_keys", key, target=whole),
        entry("preflight.key_collisions", "colliding_keys", key, target=whole)))
    return column_audits(tables).select(F.inline(columns)).unionByName(key_audits(tables).select(F.inline(keys)))


def refuse_rows(table: Incoming, allow_collisions: bool = False) -> None:
    """Raise with the first errors that a database would meet on its NOT NULL and unique key constraints.

    One pass over the incoming rows for the nulls and one shuffle of both sides' keys.
    """
    found = row_findings([table]).filter("severity = 'error'")
    if allow_collisions:
        found = found.filter("code not in ('preflight.key_collisions', 'preflight.duplicate_keys')")
    messages = [r["message"] for r in found.orderBy("code", "target").limit(5).collect()]
    if messages:
        raise RuntimeError(" ".join(messages))
