"""Applying a table's mappings to its rows: skip, cast, rename."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.casts import pg_cast, spark_type
from tidemark.functions.text import quoted
from tidemark.operators.keyed import lookup_join
from tidemark.operators.mapping import effective_dest_type


#: What a mapping must tell; any other column of a mapping table is left alone.
MAPPING_FIELDS = ("source_column", "dest_column", "source_type", "default_dest_type", "override_dest_type")


@dataclass(frozen=True)
class PlannedColumn:
    source: str
    dest: str
    cast_to: str | None


@dataclass(frozen=True)
class ColumnPlan:
    """The written columns of one table, by source name: what its mappings come to."""

    columns: tuple[PlannedColumn, ...]


Mappings = DataFrame | Sequence[Mapping] | ColumnPlan


def planned_columns(mappings: DataFrame) -> DataFrame:
    """Mappings of any number of tables with ``written`` and ``cast_to``, the type to cast to or null.

    A column is written if it is not skipped and both of its names are set; it is cast if its effective type is set and
    is not the source's own.
    """
    wanted = effective_dest_type(F.col("override_dest_type"), F.col("default_dest_type"))
    own = F.trim(F.coalesce("source_type", F.lit("")))
    named = [F.coalesce(F.length(c), F.lit(0)) > 0 for c in ("source_column", "dest_column")]
    return mappings.withColumn("written", named[0] & named[1] & ~F.coalesce("skip", F.lit(False))).withColumn(
        "cast_to", F.when((wanted != "") & (wanted != own), wanted))


def _rows(spark, mappings: Mappings) -> DataFrame:
    if isinstance(mappings, DataFrame):
        return mappings
    schema = ", ".join(f"{c} string" for c in MAPPING_FIELDS) + ", skip boolean"
    return spark.createDataFrame([(*(m.get(c) for c in MAPPING_FIELDS), bool(m.get("skip"))) for m in mappings], schema)


def _plan_of(columns: Sequence) -> ColumnPlan:
    return ColumnPlan(tuple(PlannedColumn(*c) for c in columns))


def compile_plan(mappings: DataFrame) -> dict[tuple[str, str], ColumnPlan]:
    """The column plan of every table of a mapping table, by source and destination table.

    One aggregation gives one row per table with its columns in order, as many as the table has; tables without a written
    column have none.
    """
    one = F.struct("source_column", "dest_column", "cast_to")
    rows = planned_columns(mappings).filter("written").groupBy("source_table", "dest_table").agg(F.array_sort(F.collect_list(one)).alias("columns"))
    return {(r["source_table"], r["dest_table"]): _plan_of(r["columns"]) for r in rows.collect()}


def written_columns(df: DataFrame, mappings: Mappings, generated: Sequence[str] = (), dest_table: str = "") -> list[PlannedColumn]:
    """The columns that one table's projection consists of, by source name: as many as the table has.

    Destination columns that either side computes itself are not among them.
    """
    if not isinstance(mappings, ColumnPlan):
        planned = planned_columns(_rows(df.sparkSession, mappings)).filter("written").select("source_column", "dest_column", "cast_to")
        mappings = _plan_of(planned.orderBy("source_column", "dest_column").collect())
    found = list(mappings.columns)
    if not found:
        raise ValueError(fixed.EMPTY_COLUMN_PLAN)
    own = [c for c in found if c.dest not in generated]
    if not own:
        raise ValueError(fixed.ALL_GENERATED % dest_table)
    return own


def _value(df: DataFrame, column: PlannedColumn, safe: bool = False) -> Column:
    if column.cast_to is None:
        return quoted(column.source)
    return pg_cast(quoted(column.source), df.schema[column.source].dataType, column.cast_to, safe)


def project(
    df: DataFrame, mappings: Mappings, generated: Sequence[str] = (), dest_table: str = "",
) -> DataFrame:
    """The rows as the destination receives them: one projection inside the scan's stage."""
    return df.select(*[_value(df, c).alias(c.dest) for c in written_columns(df, mappings, generated, dest_table)])


def lossy_audit(df: DataFrame, mappings: Mappings) -> DataFrame:
    """Per cast column, the values that would not survive: rejected ones and ones that change.

    A value changes when casting it to the planned type and back gives another value. One pass for all columns.
    """
    planned = [c for c in written_columns(df, mappings) if c.cast_to is not None]
    # each cast is projected once, then compared and counted
    casts = df.select(*[x for i, c in enumerate(planned) for x in (
        quoted(c.source).alias(f"_s{i}"), _value(df, c, safe=True).alias(f"_t{i}"))])
    back = casts.select("*", *[
        F.col(f"_t{i}").try_cast(df.schema[c.source].dataType).alias(f"_b{i}") for i, c in enumerate(planned)])
    totals = back.agg(*[F.expr(x) for i in range(len(planned)) for x in (
        f"count_if(_s{i} is not null and _t{i} is null) as _r{i}",
        f"count_if(_s{i} is not null and _t{i} is not null and not (_b{i} <=> _s{i})) as _c{i}")])
    rows = F.array(*[
        F.struct(F.lit(c.source).alias("column_name"), F.lit(c.cast_to).alias("dest_type"),
                 F.col(f"_r{i}").alias("rejected_rows"), F.col(f"_c{i}").alias("changed_rows"))
        for i, c in enumerate(planned)])
    return totals.select(F.inline(rows))


def planned_schema(df: DataFrame, mappings: Mappings) -> dict[str, str]:
    """Spark type of every destination column."""
    types = {}
    for c in written_columns(df, mappings):
        own = df.schema[c.source].dataType
        target = own if c.cast_to is None else spark_type(c.cast_to, own)
        types[c.dest] = target if isinstance(target, str) else target.simpleString()
    return types


def fk_remap(df: DataFrame, column: str, lookup: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a key column through a lookup table; keys the lookup does not have stay as they are.

    An old key with several new keys takes the smallest, so the row count never changes.
    """
    pairs = lookup.groupBy(quoted(old).alias(column)).agg(F.min(quoted(new)).alias("_new"))
    joined = lookup_join(df, pairs, [column], "left")
    return joined.withColumn(column, F.coalesce("_new", quoted(column))).select(*[quoted(c) for c in df.columns])
