"""Loading projected rows into a destination folder."""

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tidemark import fixed_values as fixed
from tidemark.operators.rowaudit import Declared, Incoming, refuse_rows
from tidemark.sources.storage import discard, overlapping, path_exists, publish, qualified, recover, resolve, stage

MODES = ("truncate", "append", "abort")


@dataclass(frozen=True)
class LoadMetrics:
    dest_table: str
    rows_read: int
    rows_written: int
    duration_ms: int


def skipped_tables(only_in_source: DataFrame) -> DataFrame:
    """Tables without a destination are reported, never created."""
    return only_in_source.select(
        F.col("table_label").alias("source_table"), F.lit(fixed.SKIPPED_TABLE_REASON).alias("reason"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows with their count observed while they pass; no second scan."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def read_dest(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The destination's rows; a folder that does not exist yet is an empty table.

    Nothing is moved: while the destination is being published its old rows are read.
    """
    folder = resolve(spark, path)
    if folder is not None:
        return spark.read.schema(schema).format(fmt).load(folder)
    return spark.createDataFrame([], schema)


def source_folders(rows: DataFrame, source_path: str | None = None) -> list[str]:
    """The folders that rows are read from, or the given one, as qualified paths."""
    found = [source_path] if source_path is not None else sorted({f.rsplit("/", 1)[0] for f in rows.inputFiles()})
    return [qualified(rows.sparkSession, f) for f in found]


def refuse_own_source(dest: str, sources: Sequence[str], shown: str) -> None:
    """A destination that is, holds or lies in what is read would lose it; all paths are qualified."""
    if any(overlapping(dest, s) for s in sources):
        raise ValueError(f"source and destination are the same: {shown}")


def staged_whole(rows: DataFrame, seen: Observation, dest: str, fmt: str = "parquet") -> tuple[str, int]:
    """Stage rows and count them as written; a folder with other than the rows that were read is refused."""
    spark = rows.sparkSession
    folder = stage(rows, dest, fmt)
    written = spark.read.format(fmt).schema(rows.schema).load(folder).count()
    if written != seen.get["rows"]:
        discard(spark, folder)
        raise RuntimeError(f"{seen.get['rows']:,} rows were read for {dest} and {written:,} were written")
    return folder, written


def _abort_if_filled(spark: SparkSession, dest: str, dest_table: str, fmt: str) -> None:
    if not path_exists(spark, dest):
        return
    present = spark.read.format(fmt).load(dest)
    if not present.isEmpty():
        raise RuntimeError(fixed.ABORT_NOT_EMPTY % (dest_table, f"{present.count():,}"))


def load(
    rows: DataFrame, dest: str, mode: str, dest_table: str = "",
    source_path: str | None = None, fmt: str = "parquet", key: Sequence[str] = (), not_null: Sequence[str] = (),
    allow_collisions: bool = False,
) -> LoadMetrics:
    """Write projected rows to ``dest`` and count them on the way.

    truncate replaces the data, append adds to it, abort refuses a destination with rows. Replaced data
    is staged first and swapped in; an append becomes visible when Spark commits the job. A failed load
    leaves the destination as it was.

    Rows that lack a value of ``not_null`` are refused in every mode. An append with a ``key`` is refused when incoming keys repeat,
    lack a part or are in the destination already, unless ``allow_collisions`` lets them be doubled; without a key nothing is tested.
    """
    if mode not in MODES:
        raise ValueError(f"unknown conflict mode: {mode}")
    spark = rows.sparkSession
    refuse_own_source(qualified(spark, dest), source_folders(rows, source_path), dest)
    recover(spark, [dest])
    started = time.monotonic()
    if mode == "abort":
        _abort_if_filled(spark, dest, dest_table or dest, fmt)
    refuse_violations(rows, dest, mode, dest_table or dest, fmt, key, not_null, allow_collisions)
    out, read = counted(rows, "read")
    if mode == "truncate":
        folder, written = staged_whole(out, read, dest, fmt)
        publish(spark, {dest: folder})
    else:
        before = _rows_in(spark, dest, rows.schema, fmt)
        out.write.format(fmt).mode("append").save(dest)
        written = _rows_in(spark, dest, rows.schema, fmt) - before
    return LoadMetrics(dest_table or dest, read.get["rows"], written, int((time.monotonic() - started) * 1000))


def refuse_violations(
    rows: DataFrame, dest: str, mode: str, dest_table: str, fmt: str = "parquet", key: Sequence[str] = (), not_null: Sequence[str] = (),
    allow_collisions: bool = False,
) -> None:
    """Raise if the rows break what the destination declares; nothing is read where nothing is declared."""
    key = key if mode == "append" else ()
    if not key and not not_null:
        return
    present = read_dest(rows.sparkSession, dest, rows.schema, fmt) if key else None
    declared = [Declared(c, "", nullable=False) for c in not_null]
    refuse_rows(Incoming(dest_table, rows, declared, key, present), allow_collisions)


def _rows_in(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> int:
    return spark.read.format(fmt).schema(schema).load(path).count() if path_exists(spark, path) else 0


def stage_all(spark: SparkSession, work: Sequence[Callable[[], tuple[str, int]]], concurrency: int) -> list[tuple[str, int] | Exception]:
    """Run staging jobs a few at a time; each gives its folder and rows, or the error it ended with."""
    def one(job):
        try:
            return job()
        except Exception as e:
            return e
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        return list(pool.map(one, work))


def truncate_all(
    loads: Sequence[tuple[DataFrame, str]], fmt: str = "parquet", source_paths: Sequence[str | None] | None = None, concurrency: int = 4,
) -> list[int]:
    """Replace a set of destinations together; returns the rows written to each.

    Every table is staged before any destination changes, so a failed load leaves the whole set as it
    was, and no staged folder. A destination named twice, or one that overlaps the source of any of the tables, is an error.
    """
    dests = [dest for _, dest in loads]
    spark = loads[0][0].sparkSession
    whole = [qualified(spark, d) for d in dests]
    if any(overlapping(a, b) for i, a in enumerate(whole) for b in whole[:i]):
        raise ValueError("a destination appears twice")
    paths = source_paths or [None] * len(loads)
    sources = sorted({f for (df, _), path in zip(loads, paths) for f in source_folders(df, path)})
    for dest, shown in zip(whole, dests):
        refuse_own_source(dest, sources, shown)
    recover(spark, dests)

    def job(k: int):
        df, dest = loads[k]
        out, seen = counted(df, f"staged{k}")
        return staged_whole(out, seen, dest, fmt)

    done = stage_all(spark, [lambda k=k: job(k) for k in range(len(loads))], concurrency)
    failed = [e for e in done if isinstance(e, Exception)]
    if failed:
        for got in done:
            if not isinstance(got, Exception):
                discard(spark, got[0])
        raise failed[0]
    publish(spark, {dest: folder for dest, (folder, _) in zip(dests, done)})
    return [rows for _, rows in done]
