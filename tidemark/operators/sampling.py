"""Repeatable samples of many tables at once: a mergeable bottom-k that is keyed by the number of the table."""

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.canon import hash_sql
from tidemark.functions.text import quoted
from tidemark.operators.keyed import local_rows, union_all
from tidemark.sources.storage import stored

#: Hex digits of a row's place that a cut compares, and parts in which a table's smallest rows are found before they meet.
DIGITS = 15
PARTS = 64
#: Tables whose samples are taken and compared in one job; it bounds what is broadcast.
TOGETHER = 100


@dataclass(frozen=True)
class Sampled:
    """A table to sample, under a number."""

    number: int
    df: DataFrame = field(repr=False)
    key: tuple[str, ...]
    columns: tuple[str, ...]


def sample_size(rows: Column) -> Column:
    wanted = F.greatest(
        F.lit(fixed.SAMPLE_FLOOR), F.floor(rows.cast("double") * F.lit(fixed.SAMPLE_FRACTION)))
    return F.least(F.lit(fixed.SAMPLE_CEILING), wanted, rows).cast("bigint")


def wanted_rows(rows: int) -> int:
    """The sample size of a table of so many rows, as sample_size says it."""
    return min(fixed.SAMPLE_CEILING, max(fixed.SAMPLE_FLOOR, int(rows * fixed.SAMPLE_FRACTION)), rows)


def key_text(key: Sequence[str]) -> Column:
    if len(key) == 1:
        return quoted(key[0]).cast("string")
    return F.concat(F.lit("("), F.concat_ws(", ", *[quoted(k).cast("string") for k in key]), F.lit(")"))


def cut_below(rows: int, wanted: int) -> str | None:
    """The place below which the wanted rows lie, with a margin that is missed about once in a million; None: anywhere.

    Places are evenly spread hashes, so the number of rows below a cut is known up to a few of its square roots.
    """
    share = (wanted + 5 * math.sqrt(wanted) + 25) / max(1, rows)
    return None if share >= 1 else f"{int(share * 16 ** DIGITS):0{DIGITS}x}"


def row_counts(tables: Sequence[Sampled]) -> dict[int, int]:
    """Rows by number of the table, in one job that reads no column."""
    seen = union_all([t.df.select(F.lit(t.number).cast("bigint").alias("pair")) for t in tables])
    return {t.number: 0 for t in tables} | {r["pair"]: r["n"] for r in seen.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def _candidates(table: Sampled, seed: str, cut: str | None) -> DataFrame:
    """(pair, place, key, match, row_hash) of the rows below the cut; only these are hashed."""
    place = F.md5(F.concat(key_text(table.key), F.lit(str(seed))))
    rows = table.df.select(*[quoted(c) for c in dict.fromkeys([*table.key, *table.columns])], place.alias("_place"))
    below = rows if cut is None else rows.filter(F.col("_place") < cut)
    return below.select(
        F.lit(table.number).cast("bigint").alias("pair"), F.col("_place").alias("place"), key_text(table.key).alias("key"),
        F.expr(hash_sql(table.df, table.key)).alias("match"), F.expr(hash_sql(table.df, table.columns)).alias("row_hash"))


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` first different rows of every pair by place, numbered by rn.

    Every task keeps its own first rows of a pair, then each part of the pair, then the pair: whatever the number of tasks,
    the last step sees at most ``most`` rows a part.
    """
    order = ["place", "match", "row_hash"]
    dealt = rows.distinct().withColumn("_part", F.pmod(F.xxhash64("match", "row_hash"), F.lit(PARTS)))
    part = Window.partitionBy("pair", "_part").orderBy(*order)
    first = dealt.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= most).drop("rn", "_part")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("pair").orderBy(*order))).filter(F.col("rn") <= most)


def samples(tables: Sequence[Sampled], seed: str = "0", cuts: dict[int, str | None] | None = None) -> DataFrame:
    """(pair, place, key, match, row_hash, rn): the key sample of every table, 1 % of its rows, at least 100, at most 1000.

    Rows are taken in the order of a hash of key and seed, equal rows once. All tables go through one pass that hashes only
    the rows below a cut which follows from the number of rows; tables where this leaves too few are read once more without it.
    """
    spark, counts = tables[0].df.sparkSession, row_counts(tables)
    wanted = {n: wanted_rows(rows) for n, rows in counts.items()}
    cuts = cuts if cuts is not None else {n: cut_below(rows, wanted[n]) for n, rows in counts.items()}

    def taken(some: Sequence[Sampled], below: dict[int, str | None]) -> DataFrame:
        found = smallest(union_all([_candidates(t, seed, below.get(t.number)) for t in some]), fixed.SAMPLE_CEILING)
        sizes = local_rows(spark, [(t.number, wanted[t.number]) for t in some], pa.schema([("pair", pa.int64()), ("wanted", pa.int64())]))
        return stored(found.join(F.broadcast(sizes), "pair").filter("rn <= wanted").drop("wanted"), "sample")[0]

    found = taken(tables, cuts)
    have = {r["pair"]: r["n"] for r in found.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    short = [t for t in tables if cuts.get(t.number) is not None and have.get(t.number, 0) < wanted[t.number]]
    if short:
        whole = taken(short, {})
        found = found.filter(~F.col("pair").isin([t.number for t in short])).unionByName(whole)
    return found


def compared(tables: Sequence[Sampled], dests: Sequence[DataFrame], seed: str = "0") -> DataFrame:
    """(pair, sample_size, missing, mismatched, missing_count, mismatched_count) of each table's sample against its destination.

    Destinations are read once. What is broadcast into their scans is two numbers and 32 digits for each of at most 1000 rows
    a table, of at most TOGETHER tables. A key is compared by its canonical text, so that its type may differ.
    """
    spark = tables[0].df.sparkSession
    parts = []
    for start in range(0, len(tables), TOGETHER):
        some = tables[start:start + TOGETHER]
        keys = samples(some, seed).groupBy("pair", "match").agg(F.min("row_hash").alias("source_hash"), F.min("key").alias("key"))
        wanted = F.broadcast(keys.select(F.col("pair").alias("_pair"), F.col("match").alias("_match")))
        met = []
        for t, dest in zip(some, dests[start:start + TOGETHER]):
            rows = dest.select(
                *[quoted(c) for c in dict.fromkeys([*t.key, *t.columns])], F.lit(t.number).cast("bigint").alias("_pair"),
                F.expr(hash_sql(dest, t.key)).alias("_match")).join(wanted, ["_pair", "_match"], "left_semi")
            met.append(rows.select(F.col("_pair").alias("pair"), F.col("_match").alias("match"), F.expr(hash_sql(dest, t.columns)).alias("h")))
        found = union_all(met).groupBy("pair", "match").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        missing = F.col("low").isNull()
        changed = ~missing & ((F.col("low") != F.col("source_hash")) | (F.col("high") != F.col("source_hash")))
        seeds = local_rows(spark, [(t.number,) for t in some], pa.schema([("pair", pa.int64())]))
        per_pair = keys.join(found, ["pair", "match"], "left").groupBy("pair").agg(
            F.count("*").alias("sample_size"), F.count_if(missing).alias("missing_count"), F.count_if(changed).alias("mismatched_count"),
            F.sort_array(F.collect_list(F.when(missing, F.col("key")))).alias("missing"),
            F.sort_array(F.collect_list(F.when(changed, F.col("key")))).alias("mismatched"))
        nothing = F.expr("cast(array() as array<string>)")
        parts.append(seeds.join(per_pair, "pair", "left").select(
            "pair", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("sample_size", "missing_count", "mismatched_count")],
            *[F.coalesce(c, nothing).alias(c) for c in ("missing", "mismatched")]))
    return union_all(parts)
