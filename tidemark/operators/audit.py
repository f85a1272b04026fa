"""Audits of rows and plans before anything is written.

Every audit of a plan returns findings with severity, code, message and target.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import quoted, thousands, with_schema
from tidemark.operators.keyed import frequent_keys, lookup_join, tally, union_all

FINDING = ["severity", "code", "message", "target"]


def finding(rows: DataFrame, code: str, *values: Column, target: Column | None = None) -> DataFrame:
    severity, template = fixed.FINDINGS[code]
    message = F.format_string(template, *values) if values else F.lit(template)
    return rows.select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"),
        (target if target is not None else F.lit(None).cast("string")).alias("target"))


def _table(name: Column) -> Column:
    return F.concat(F.lit("table:"), name)


# --- rows: foreign keys ----------------------------------------------------------------------------

@dataclass(frozen=True)
class ForeignKey:
    child_table: str
    child: DataFrame = field(repr=False)
    child_column: str
    parent_table: str
    parent: DataFrame = field(repr=False)
    parent_column: str


def orphan_rows(foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """Per foreign key, the child rows whose non-null key has no parent; keys without orphans show 0.

    Child and parent keys meet in one aggregation on the key value. Each task collapses its own
    repeats first, so a parent that owns a third of the child rows costs one row per task.
    """
    def one(fk: ForeignKey) -> DataFrame:
        child = fk.child.select(quoted(fk.child_column).alias("key")).filter("key is not null")
        parent = fk.parent.select(quoted(fk.parent_column).alias("key")).filter("key is not null")
        unmatched = tally(["key"], {"child": child, "parent": parent}).filter("parent = 0")
        return unmatched.agg(F.coalesce(F.sum("child"), F.lit(0)).alias("orphan_rows")).select(
            F.lit(fk.child_table).alias("child_table"), F.lit(fk.child_column).alias("child_column"),
            F.lit(fk.parent_table).alias("parent_table"), F.lit(fk.parent_column).alias("parent_column"),
            "orphan_rows")

    return union_all([one(fk) for fk in foreign_keys])


def orphan_findings(orphans: DataFrame) -> DataFrame:
    return finding(
        orphans.filter("orphan_rows > 0"), "preflight.orphan_rows",
        F.col("child_table"), thousands(F.col("orphan_rows")), F.col("child_column"),
        F.col("parent_table"), F.col("parent_column"), target=_table(F.col("child_table")))


# --- rows: keys, nulls, lengths ---------------------------------------------------------------------

def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; as under UNIQUE, a key with a null never clashes."""
    present = df.select(*[quoted(k) for k in key]).dropna(how="any")
    return tally(key, {"rows": present}).filter("rows > 1")


def pk_collisions(src: DataFrame, dst: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of incoming rows that the destination already holds, with the rows on both sides."""
    def present(df: DataFrame) -> DataFrame:
        return df.select(*[quoted(k) for k in key]).dropna(how="any")

    both = tally(key, {"source_rows": present(src), "dest_rows": present(dst)})
    return both.filter("source_rows > 0 and dest_rows > 0")


def _per_column(df: DataFrame, counts: Mapping[str, Column], name: str) -> DataFrame:
    """Named counts of one pass over the table, as one row per column."""
    totals = df.agg(*[F.count_if(c).alias(f"_c{i}") for i, c in enumerate(counts.values())])
    rows = F.array(*[
        F.struct(F.lit(column).alias("column_name"), F.col(f"_c{i}").alias(name)) for i, column in enumerate(counts)])
    return totals.select(F.inline(rows))


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null values per column that the destination declares NOT NULL; one pass for all columns."""
    return _per_column(df, {c: quoted(c).isNull() for c in columns}, "null_rows")


def length_violations(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Values longer than the destination's varchar(n), per column; one pass for all columns."""
    return _per_column(df, {c: F.length(quoted(c)) > n for c, n in limits.items()}, "too_long_rows")


# --- plans ----------------------------------------------------------------------------------------------
# plan: source_table, dest_table, conflict_mode; tables: qn, row_count

def plan_state(plan: DataFrame, source_tables: DataFrame, dest_tables: DataFrame) -> DataFrame:
    """The plan with the rows each side holds; null means the table does not exist."""
    rows = plan.select("source_table", "dest_table", "conflict_mode")
    for side, tables in (("source", source_tables), ("dest", dest_tables)):
        # many plan rows may name one table
        named = with_schema(F.col(f"{side}_table"))
        frequent = frequent_keys(plan.select(named.alias("_qn")), ["_qn"])
        lookup = tables.select(F.col("qn").alias("_qn"), F.col("row_count").cast("bigint").alias(f"{side}_rows"))
        rows = lookup_join(rows.withColumn("_qn", named), lookup, ["_qn"], "left", frequent=frequent).drop("_qn")
    return rows


def plan_findings(state: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """The findings about each planned table, or only those with the given codes, in one pass over the plan.

    A table missing on the source gets no other finding, one missing on the destination no later one.
    """
    source, dest = F.col("source_table"), F.col("dest_table")
    present = F.col("source_rows").isNotNull() & (F.col("dest_rows") > 0)
    rows = thousands(F.col("dest_rows"))
    mode = F.col("conflict_mode")
    rules = {
        "preflight.source_table_missing": (F.col("source_rows").isNull(), [source], source),
        "preflight.dest_table_missing": (
            F.col("source_rows").isNotNull() & F.col("dest_rows").isNull(), [dest], dest),
        "preflight.dest_not_empty": (present & (mode == "abort"), [dest], dest),
        "preflight.will_truncate": (present & (mode == "truncate"), [dest, rows], dest),
        "preflight.will_append": (present & (mode == "append"), [dest, rows], dest),
    }

    def entry(code: str) -> Column:
        condition, values, target = rules[code]
        severity, template = fixed.FINDINGS[code]
        return F.when(condition, F.struct(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"),
            F.format_string(template, *values).alias("message"), _table(target).alias("target")))

    return state.select(F.inline(F.array_compact(F.array(*[entry(c) for c in codes or rules]))))


def would_truncate_counts(state: DataFrame) -> DataFrame:
    """Rows that a run would wipe, per destination table."""
    wiped = state.filter("conflict_mode = 'truncate' and source_rows is not null and dest_rows > 0")
    return wiped.groupBy("dest_table").agg(F.max("dest_rows").alias("rows_lost"))


def no_mapped_columns(plan: DataFrame, mappings: DataFrame) -> DataFrame:
    mapped = mappings.groupBy("source_table", "dest_table").agg(F.count_if(~F.col("skip")).alias("mapped"))
    covered = plan.select("source_table", "dest_table").join(mapped, ["source_table", "dest_table"], "left")
    return finding(covered.filter("coalesce(mapped, 0) = 0"), "preflight.no_mapped_columns",
                   F.col("source_table"), F.col("dest_table"), target=_table(F.col("source_table")))


def dest_column_missing(mappings: DataFrame, dest_columns: DataFrame) -> DataFrame:
    """Mapped columns the destination does not have; their load would fail."""
    wanted = mappings.filter("not skip").select(
        F.col("dest_table").alias("qn"), F.col("dest_column").alias("name")).distinct()
    absent = wanted.join(dest_columns.select("qn", "name").distinct(), ["qn", "name"], "left_anti")
    return absent.select(
        F.lit("error").alias("severity"), F.lit("preflight.dest_column_missing").alias("code"),
        F.format_string("Destination %s has no column %s.", F.col("qn"), F.col("name")).alias("message"),
        F.format_string("column:%s.%s", F.col("qn"), F.col("name")).alias("target"))


def no_tables(plan: DataFrame) -> DataFrame:
    return finding(plan.agg(F.count("*").alias("n")).filter("n = 0"), "preflight.no_tables")


def preflight(
    plan: DataFrame, source_tables: DataFrame, dest_tables: DataFrame, mappings: DataFrame,
    foreign_keys: Sequence[ForeignKey] = (), rows: DataFrame | None = None,
) -> DataFrame:
    """All findings about one plan; every given foreign key of a planned table is scanned whole.

    ``rows`` are the findings about the incoming rows themselves, by ``rowaudit.row_findings``.
    """
    parts = [no_tables(plan), plan_findings(plan_state(plan, source_tables, dest_tables)), no_mapped_columns(plan, mappings)]
    if foreign_keys:
        planned = plan.select(F.col("source_table").alias("child_table")).distinct()
        scanned = orphan_rows(foreign_keys).join(planned, ["child_table"], "left_semi")
        parts.append(orphan_findings(scanned))
    if rows is not None:
        parts.append(rows.select(*FINDING))
    return union_all(parts)


def can_run(findings: DataFrame) -> DataFrame:
    """One row: true unless some finding is an error."""
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("can_run"))


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Findings per severity and code, largest group first within a severity."""
    return findings.groupBy("severity", "code").agg(F.count("*").alias("findings")).orderBy(
        F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("severity")),
        F.desc("findings"), "code")


def wiped_rollup(findings: DataFrame, state: DataFrame) -> DataFrame:
    """finding_rollup with each group's place in the report and, beside the truncations, the rows that they would wipe in total.

    A destination that several plan rows truncate is wiped once. The groups are few: codes, whatever the plan's size.
    """
    total = would_truncate_counts(state).agg(F.coalesce(F.sum("rows_lost"), F.lit(0)).cast("bigint")).scalar()
    rank = F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("severity"))
    place = Window.orderBy(rank, F.desc("findings"), "code")
    groups = findings.groupBy("severity", "code").agg(F.count("*").alias("findings"))
    lost = F.when(F.col("code") == "preflight.will_truncate", total).otherwise(F.lit(0).cast("bigint"))
    return groups.withColumn("position", F.row_number().over(place)).select(
        "position", "severity", "code", "findings", lost.alias("rows_wiped"))
