"""Running a migration plan: project, load and verify every table."""

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import fixed_values as fixed
from tidemark.operators.graph import dependency_levels
from tidemark.operators.load import (
    LoadMetrics, counted, load, read_dest, refuse_own_source, refuse_violations, source_folders, stage_all, staged_whole)
from tidemark.operators.marks import high_water_marks
from tidemark.operators.projection import ColumnPlan, Mappings, compile_plan, project
from tidemark.operators.verify import TablePair, overall
from tidemark.plans.verification import run_checks
from tidemark.sources.storage import overlapping, publish, qualified, recover


@dataclass(frozen=True)
class TableMove:
    """One table of a plan: its rows, where they go and how.

    Without ``mappings`` of its own it takes those that the run's mapping table has for it. ``not_null`` names destination columns
    that must have a value; an append tests its ``key`` unless ``allow_collisions`` says otherwise.
    """

    source_table: str
    dest_table: str
    source: DataFrame = field(repr=False)
    dest_path: str
    mappings: Mappings | None = field(repr=False)
    conflict_mode: str = "truncate"
    verification: str | None = fixed.DEFAULT_LEVEL
    key: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    sequences: tuple[tuple[str, str], ...] = ()
    source_path: str | None = None
    not_null: tuple[str, ...] = ()
    allow_collisions: bool = False


RUN_TABLE_SCHEMA = (
    "source_table string, dest_table string, conflict_mode string, status string, rows_read bigint, "
    "rows_written bigint, duration_ms bigint, verification array<struct<name:string,passed:boolean,detail:string,"
    "metrics:map<string,string>,error:string>>, error string, started_at timestamp, finished_at timestamp")
RUN_SCHEMA = "status string, succeeded bigint, failed bigint, error string"


def load_waves(spark: SparkSession, moves: Sequence[TableMove], edges: DataFrame | None) -> list[list[TableMove]]:
    """Tables by dependency level, parents first; members of a cycle come last in plan order."""
    if edges is None:
        return [list(moves)]
    names = spark.createDataFrame([(m.source_table,) for m in moves], "node string")
    level = {r["node"]: r["level"] for r in dependency_levels(edges, names).collect()}
    last = max([v for v in level.values() if v is not None], default=-1) + 1
    waves: dict[int, list[TableMove]] = {}
    for m in moves:
        at = level[m.source_table]
        waves.setdefault(last if at is None else at, []).append(m)
    return [waves[k] for k in sorted(waves)]


def _truncated_together(
    moves: Sequence[TableMove], refused: dict[int, str], concurrency: int,
) -> tuple[dict[int, LoadMetrics], dict[int, str]]:
    """Stage every truncate table, a few at a time, then replace all destinations at once.

    Returns the metrics of the tables that were loaded and the error of those that were not.
    Tables that fail to stage keep their old data; the others are still published.
    """
    spark = moves[0].source.sparkSession
    chosen = [i for i, m in enumerate(moves) if m.conflict_mode == "truncate" and i not in refused]

    def job(i: int):
        m, started = moves[i], time.monotonic()
        rows = project(m.source, m.mappings, m.generated, m.dest_table)
        refuse_violations(rows, m.dest_path, m.conflict_mode, m.dest_table, not_null=m.not_null)
        out, seen = counted(rows, f"staged{i}")
        folder, written = staged_whole(out, seen, m.dest_path)
        return folder, LoadMetrics(m.dest_table, seen.get["rows"], written, int((time.monotonic() - started) * 1000))

    loaded, errors, staged = {}, {}, {}
    for i, got in zip(chosen, stage_all(spark, [lambda i=i: job(i) for i in chosen], concurrency)):
        if isinstance(got, Exception):
            errors[i] = str(got)
        else:
            staged[moves[i].dest_path], loaded[i] = got
    if staged:
        try:
            publish(spark, staged)
        except Exception as e:
            errors.update({i: str(e) for i in loaded})
            loaded = {}
    return loaded, errors


def _refused(moves: Sequence[TableMove]) -> dict[int, str]:
    """The moves that would destroy a source of the plan, or that share a destination, by number."""
    spark, out = moves[0].source.sparkSession, {}
    dests = [qualified(spark, m.dest_path) for m in moves]
    sources: set[str] = set()
    for i, m in enumerate(moves):
        try:
            sources.update(source_folders(m.source, m.source_path))
        except Exception as e:
            out[i] = str(e)
    for i, m in enumerate(moves):
        try:
            refuse_own_source(dests[i], sorted(sources), m.dest_path)
            if m.conflict_mode == "truncate" and any(j != i and overlapping(dests[i], d) for j, d in enumerate(dests)):
                raise ValueError(f"a destination appears twice: {m.dest_path}")
        except ValueError as e:
            out.setdefault(i, str(e))
    return out


def run_migration(
    moves: Sequence[TableMove], edges: DataFrame | None = None, marks: DataFrame | None = None,
    concurrency: int = 4, mappings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run, run tables, marks): every table projected, loaded, marked and verified.

    ``mappings`` is the mapping table of the whole plan; it is compiled once, by one aggregation, for all moves that bring none.

    Before anything is staged, moves onto any source of the plan are refused. Truncate tables are replaced together first.
    Append and abort tables follow by dependency level, a few at a time; Spark runs each as its own jobs. A table that fails
    to load or to verify fails alone and the run is failed if any table is. What a load wrote must be exactly what it read,
    whatever the level's tolerance. Loaded data stays when its verification fails; a verification that cannot run at all
    still leaves the record of what was loaded.
    """
    spark = moves[0].source.sparkSession
    plans = compile_plan(mappings) if mappings is not None else {}
    moves = [m if m.mappings is not None else replace(
        m, mappings=plans.get((m.source_table, m.dest_table), ColumnPlan(()))) for m in moves]
    started = {}
    begun = datetime.now(timezone.utc)
    recover(spark, [m.dest_path for m in moves])
    errors = _refused(moves)
    loaded, failed_loads = _truncated_together(moves, errors, concurrency)
    errors.update(failed_loads)

    def one(i: int) -> None:
        m = moves[i]
        started[i] = datetime.now(timezone.utc)
        try:
            rows = project(m.source, m.mappings, m.generated, m.dest_table)
            loaded[i] = load(rows, m.dest_path, m.conflict_mode, m.dest_table, m.source_path, key=m.key, not_null=m.not_null,
                             allow_collisions=m.allow_collisions)
        except Exception as e:
            errors[i] = str(e)

    # truncate tables are in place already, so only the other tables wait for each other
    number = {id(m): i for i, m in enumerate(moves)}
    waiting = [m for i, m in enumerate(moves) if m.conflict_mode != "truncate" and i not in errors]
    for wave in load_waves(spark, waiting, edges) if waiting else []:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            list(pool.map(one, [number[id(m)] for m in wave]))

    for i, done in loaded.items():
        if done.rows_read != done.rows_written:
            errors[i] = f"{done.rows_read:,} rows were read and {done.rows_written:,} were written"

    pairs: dict[int, TablePair] = {}
    for i in sorted(loaded):
        m = moves[i]
        try:
            rows = project(m.source, m.mappings, m.generated, m.dest_table)
            dest = read_dest(spark, m.dest_path, rows.schema)
            pairs[i] = TablePair(m.source_table, m.dest_table, rows, dest, m.key, None, m.sequences, m.verification)
        except Exception as e:
            errors.setdefault(i, str(e))
    advanced = marks
    sequenced = {p.dest_table: (p.dest, [c for c, _ in p.sequences]) for p in pairs.values() if p.sequences}
    if sequenced:
        advanced = high_water_marks(sequenced, marks)
    if advanced is None:
        advanced = spark.createDataFrame([], "table_name string, column_name string, last_value bigint")

    checks: dict[int, list] = {}
    verdicts: dict[int, object] = {}
    if pairs:
        order = list(pairs)
        results = run_checks(list(pairs.values()), advanced)
        # a few rows per table of the plan
        for r in results.orderBy("pair", "position").collect():
            checks.setdefault(order[r["pair"]], []).append((r["name"], r["passed"], r["detail"], r["metrics"], r["error"]))
        verdicts = {order[r["pair"]]: r for r in overall(results).collect()}

    rows, first_error = [], None
    for i, m in enumerate(moves):
        done = loaded.get(i)
        error = errors.get(i)
        if error is None:
            error = verdicts[i]["error"] if verdicts[i]["status"] != "passed" else None
        else:
            first_error = first_error or error
        rows.append((
            m.source_table, m.dest_table, m.conflict_mode, "succeeded" if error is None else "failed", done and done.rows_read,
            done and done.rows_written, done and done.duration_ms, checks.get(i, []), error, started.get(i, begun),
            datetime.now(timezone.utc)))
    failed = sum(r[3] == "failed" for r in rows)
    run = (
        "failed" if failed else "succeeded", len(rows) - failed, failed,
        (first_error or fixed.TABLES_FAILED % failed) if failed else None)
    return (
        spark.createDataFrame([run], RUN_SCHEMA), spark.createDataFrame(rows, RUN_TABLE_SCHEMA), advanced)


def mappings_of(mappings: DataFrame, source_table: str, dest_table: str) -> DataFrame:
    """The mappings of one move."""
    return mappings.filter((F.col("source_table") == source_table) & (F.col("dest_table") == dest_table))


def included(plan: DataFrame) -> DataFrame:
    """The plan rows to run, with the default level where none is set."""
    return plan.filter(F.coalesce("include", F.lit(True))).withColumn(
        "verification", F.coalesce("verification", F.lit(fixed.DEFAULT_LEVEL)))

