"""Analytics over logs of runs and of the tables in them."""

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark import fixed_values as fixed
from tidemark.functions.text import plural
from tidemark.operators.keyed import lookup_join, shuffle_partitions, union_all

RUN = ["run_id", "status", "started_at", "finished_at", "created_at"]
ENTRY = ["type", "id", "label", "status", "started_at", "finished_at", "detail"]


# --- activity ------------------------------------------------------------------------------------------

def introspection_entries(snapshots: DataFrame) -> DataFrame:
    """snapshots: id, connection_id, connection_name, captured_at, table_count, warning_count."""
    return snapshots.select(
        F.lit("introspection").alias("type"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("Introspect: "), F.coalesce("connection_name", F.col("connection_id").cast("string"))).alias("label"),
        F.lit("succeeded").alias("status"), F.col("captured_at").alias("started_at"),
        F.col("captured_at").alias("finished_at"),
        F.format_string("%d tables, %d warnings", "table_count", "warning_count").alias("detail"))


def comparison_entries(comparisons: DataFrame) -> DataFrame:
    """comparisons: id, source_schema, dest_schema, created_at, common, only_source, only_dest.

    A comparison counts as running until its diff names a table.
    """
    ready = (F.col("common") + F.col("only_source") + F.col("only_dest")) > 0
    scoped = (F.coalesce("source_schema", F.lit("")) != "") & (F.coalesce("dest_schema", F.lit("")) != "")
    scope = F.when(scoped, F.format_string("schema %s → %s", "source_schema", "dest_schema")).otherwise("all schemas")
    return comparisons.select(
        F.lit("comparison").alias("type"), F.col("id").cast("string").alias("id"),
        F.format_string("Comparison (%s)", scope).alias("label"),
        F.when(ready, "succeeded").otherwise("running").alias("status"),
        F.col("created_at").alias("started_at"), F.when(ready, F.col("created_at")).alias("finished_at"),
        F.when(ready, F.format_string("%d common, %d only-in-source, %d only-in-dest", "common", "only_source", "only_dest"))
        .otherwise("computing…").alias("detail"))


def run_entries(runs: DataFrame, kind: str) -> DataFrame:
    """Migration or verification runs: id, status, created_at, started_at, finished_at, table_count, error."""
    return runs.select(
        F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit(f"{kind.capitalize()} ("), plural(F.col("table_count"), "table"), F.lit(")")).alias("label"),
        "status", F.coalesce("started_at", "created_at").alias("started_at"), "finished_at",
        F.nullif(F.col("error"), F.lit("")).alias("detail"))


def duration_ms(started: Column, finished: Column) -> Column:
    """Milliseconds between two stamps; null when one is missing or the difference is negative."""
    ms = F.timestamp_diff("MILLISECOND", started, finished)
    return F.when(ms >= 0, ms)


def activity(
    snapshots: DataFrame, comparisons: DataFrame, migrations: DataFrame, verifications: DataFrame,
    limit_per_type: int = fixed.ACTIVITY_LIMIT, kind: str | None = None,
) -> DataFrame:
    """The newest entries of each run type in one shape, newest first.

    Each type's newest stamps and ids are found with a per-task top-n of these two columns, so no log is sorted or shuffled whole
    and no whole rows of all tasks meet in one. Ids are unique in a log; rows that share stamp and id go together.
    """
    if not 1 <= limit_per_type <= fixed.ACTIVITY_LIMIT_MAX:
        raise ValueError(f"limit_per_type must be 1..{fixed.ACTIVITY_LIMIT_MAX}")

    def newest(df: DataFrame, stamp: str) -> DataFrame:
        top = df.select(F.col(stamp).alias("_stamp"), F.col("id").alias("_id")).orderBy(F.desc("_stamp"), F.desc("_id")).limit(
            limit_per_type)
        # at most ACTIVITY_LIMIT_MAX pairs
        return df.join(F.broadcast(top), F.col(stamp).eqNullSafe(F.col("_stamp")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    entries = union_all([
        introspection_entries(newest(snapshots, "captured_at")), comparison_entries(newest(comparisons, "created_at")),
        run_entries(newest(migrations, "created_at"), "migration"),
        run_entries(newest(verifications, "created_at"), "verification")])
    if kind is not None:
        entries = entries.filter(F.col("type") == kind)
    entries = entries.select(*ENTRY, duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))
    return entries.orderBy(F.desc_nulls_last(F.coalesce("finished_at", "started_at")), "type", "id")


# --- summaries -------------------------------------------------------------------------------------------

def migration_runs_summary(runs: DataFrame, run_tables: DataFrame) -> DataFrame:
    """Per run its number of tables, newest first."""
    counts = run_tables.groupBy("run_id").agg(F.count("*").alias("table_count"))
    return runs.select(*RUN).join(counts, ["run_id"], "left").select(
        "run_id", "status", "started_at", "finished_at", F.coalesce("table_count", F.lit(0)).alias("table_count"),
        "created_at").orderBy(F.desc("created_at"), "run_id")


def verification_runs_summary(runs: DataFrame, run_tables: DataFrame) -> DataFrame:
    """Per run its number of tables and how many passed and failed, newest first."""
    counts = run_tables.groupBy("run_id").agg(
        F.count("*").alias("table_count"), F.count_if(F.col("status") == "passed").alias("pass_count"),
        F.count_if(F.col("status") == "failed").alias("fail_count"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("table_count", "pass_count", "fail_count")]
    return runs.select(*RUN).join(counts, ["run_id"], "left").select(
        "run_id", "status", "started_at", "finished_at", *numbers, "created_at").orderBy(F.desc("created_at"), "run_id")


def run_totals(run_tables: DataFrame) -> DataFrame:
    """Per run: rows read and written, and tables per status."""
    return run_tables.groupBy("run_id").agg(
        F.sum(F.coalesce("rows_read", F.lit(0))).alias("rows_read"),
        F.sum(F.coalesce("rows_written", F.lit(0))).alias("rows_written"),
        *[F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUS_RANK])


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for x in chain.from_iterable(fixed.STATUS_RANK.items())])
    return F.coalesce(ranks[status], F.lit(fixed.UNKNOWN_STATUS_RANK))


def ranked_tables(run_tables: DataFrame) -> DataFrame:
    """Tables in display order: changing ones first, then by name."""
    return run_tables.withColumn("status_rank", status_rank(F.col("status"))).orderBy("run_id", "status_rank", "source_table")


def stale_tables(runs: DataFrame, run_tables: DataFrame, now: Column) -> DataFrame:
    """The table log with tables that a finished run left open marked as failed.

    An existing error or finish time is kept; tables of live runs stay as they are. ``changed`` tells
    which rows were altered.
    """
    ended = runs.filter(F.col("status").isin(fixed.TERMINAL_RUN_STATUSES)).select("run_id", F.lit(True).alias("_ended"))
    rows = lookup_join(run_tables, ended, ["run_id"], "left")
    stale = F.coalesce("_ended", F.lit(False)) & F.col("status").isin(fixed.STALE_TABLE_STATUSES)
    error = F.coalesce(F.nullif("error", F.lit("")), F.format_string(fixed.STALE_TABLE, "status"))
    replaced = {
        "status": F.when(stale, "failed").otherwise(F.col("status")),
        "error": F.when(stale, error).otherwise(F.col("error")),
        "finished_at": F.when(stale, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")),
    }
    return rows.select(*[replaced.get(c, F.col(c)).alias(c) for c in run_tables.columns], stale.alias("changed"))


# --- status transitions -----------------------------------------------------------------------------------

def is_active(status: Column) -> Column:
    return status.isin(fixed.ACTIVE_STATUSES)


def is_terminal(status: Column) -> Column:
    return status.isin(fixed.TERMINAL_STATUSES)


def _position(df: DataFrame, column: str) -> Column:
    """The column as a number of the same order."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("bigint")
    return F.col(column)


def _slice_sql(low: int, high: int) -> str:
    """How many of the sorted cuts lie below the position, as a binary search."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return f"if(_cuts[{middle}] < _position, {_slice_sql(middle + 1, high)}, {_slice_sql(low, middle)})"


def previous_value(
    events: DataFrame, keys: list[str], order: list[str], value: str, alias: str, slices: int | None = None,
) -> DataFrame:
    """``events`` with each event's previous value of the same key.

    A key may hold a large share of the log, so its events are never sorted in one task. The first order
    column is cut into slices of about equal row count, as many as there are shuffle partitions unless told otherwise, and a
    slice that holds a single value of it, as a bulk load makes them, is cut again by the second. A window per key
    and slice finds the previous values inside the slice. What precedes the first event of a slice is the last event of the
    key's latest earlier slice, so a second window over only the first and last events of each slice, at most
    two per key and slice, completes them. The full log is shuffled once.
    """
    slices = slices or max(2, shuffle_partitions(events.sparkSession))
    position = _position(events, order[0])
    shares = [i / slices for i in range(1, slices)]
    cuts = events.agg(F.percentile_approx(position, shares).alias("cuts")).scalar()
    sliced = events.withColumn("_cuts", cuts).withColumn("_position", position).withColumn(
        "_slice", F.expr(_slice_sql(0, slices - 1))).drop("_cuts")
    parts = ["_slice"]
    if len(order) > 1 and isinstance(events.schema[order[1]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        # one row per slice
        second = _position(events, order[1])
        crowded = sliced.groupBy("_slice").agg(
            F.when(F.min("_position") == F.max("_position"), F.percentile_approx(second, shares)).alias("_cuts"),
            F.count("*").alias("_rows"))
        even = sliced.agg((2 * F.count("*") / slices).alias("n")).scalar()
        crowded = crowded.filter(F.col("_cuts").isNotNull() & (F.col("_rows") > even)).drop("_rows")
        sliced = sliced.join(F.broadcast(crowded), "_slice", "left").withColumn("_position", second).withColumn(
            "_part", F.when(F.col("_cuts").isNull(), 0).otherwise(F.expr(_slice_sql(0, slices - 1)))).drop("_cuts")
        parts.append("_part")
    sliced = sliced.drop("_position")
    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    local = sliced.select(
        "*", (F.row_number().over(inside) == 1).alias("_first"), F.lead(F.lit(False), 1, True).over(inside).alias("_last"),
        F.lag(value).over(inside).alias(alias))
    later = local.filter("not _first").select(*events.columns, alias)
    edges = local.filter("_first or _last").withColumn(
        alias, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return later.unionByName(edges.filter("_first").select(*events.columns, alias))


def status_transitions(
    events: DataFrame, keys: list[str], order: list[str], status: str = "status", slices: int | None = None,
) -> DataFrame:
    """Events that end a key that was active just before."""
    rows = previous_value(events, keys, order, status, "previous_status", slices)
    return rows.filter(is_active(F.col("previous_status")) & is_terminal(F.col(status)))


def poll_transitions(polls: DataFrame, poll: str = "poll") -> DataFrame:
    """Entries that were active in one poll and are terminal in the next.

    polls: poll, type, id, status, one row per entry in each poll. The first poll only seeds and an
    entry that is absent from a poll is forgotten.
    """
    calendar = previous_value(
        polls.select(poll).distinct().withColumn("_all", F.lit(0)), ["_all"], [poll], poll, "previous_poll").drop("_all")
    rows = polls.select(poll, "type", "id", "status")
    before = rows.filter(is_active(F.col("status"))).select(
        F.col(poll).alias("previous_poll"), "type", "id", F.col("status").alias("previous_status"))
    now = lookup_join(rows.filter(is_terminal(F.col("status"))), calendar, [poll], "inner")
    return now.join(before, ["type", "id", "previous_poll"], "inner").select(
        poll, "type", "id", "previous_status", "status")
