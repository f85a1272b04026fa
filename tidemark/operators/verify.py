"""Parity checks between a source and a destination table.

Each check takes any number of table pairs and returns one row per pair, so a whole migration is
checked in one job. Counts, digests and column maxima come out of one shared pass per table.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.canon import (
    HALVES, LIMBS, digest_value, half_sql, hash_sql, limb_sql, name_sql)
from tidemark.functions.text import quoted, signed_thousands, thousands
from tidemark.operators.keyed import local_rows, union_all
from tidemark.operators.sampling import Sampled, compared, samples

PAIR = ["source_table", "dest_table"]
#: The number of a pair among those checked together: names may repeat, numbers do not.
NUMBERED = ["pair", *PAIR]


@dataclass(frozen=True)
class TablePair:
    """Two tables to compare; ``sequences`` maps destination columns to their sequence names."""

    source_table: str
    dest_table: str
    source: DataFrame = field(repr=False)
    dest: DataFrame = field(repr=False)
    key: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    sequences: tuple[tuple[str, str], ...] = ()
    level: str | None = fixed.DEFAULT_LEVEL

    def compared(self) -> list[str]:
        return list(self.columns) if self.columns is not None else self.source.columns

    def checks(self) -> list[str]:
        level = self.level or fixed.DEFAULT_LEVEL
        return fixed.VERIFICATION_LEVELS.get(level, fixed.VERIFICATION_LEVELS[fixed.DEFAULT_LEVEL])


def pair_totals(
    pairs: Sequence[TablePair], digest: Sequence[TablePair] = (), maxima: Sequence[TablePair] = (),
) -> DataFrame:
    """One row per pair: rows on each side, and for the named pairs digests and sequence-column maxima.

    All tables feed one aggregation. Every task reduces its rows first, so only a few rows per task
    are shuffled whatever the table sizes; a seed row per pair keeps empty tables in the result.
    """
    spark = pairs[0].source.sparkSession
    slots = max([len(p.sequences) for p in maxima], default=0)

    def side(number: int, pair: TablePair, df: DataFrame, is_source: bool) -> DataFrame:
        columns = [
            f"{number}L as pair", f"{_text(pair.source_table)} as source_table", f"{_text(pair.dest_table)} as dest_table",
            f"{int(is_source)}L as source", f"{int(not is_source)}L as dest"]
        named = [c for c, _ in pair.sequences] if any(pair is p for p in maxima) and not is_source else []
        maximum = [
            f"cast({name_sql(named[i]) if i < len(named) else 'null'} as bigint) as _max{i}" for i in range(slots)]
        if not any(pair is p for p in digest):
            zeros = [f"0L as _d{h}{i}{s}" for h in range(HALVES) for i in range(LIMBS) for s in "st"]
            return df.selectExpr(*columns, *maximum, *(zeros if digest else []))
        # hash, halves and limbs are projected one after the other, so each is computed once per row
        hashed = df.selectExpr(*columns, *maximum, f"{hash_sql(df, pair.compared())} as _hash")
        kept = [c for c in hashed.columns if c != "_hash"]
        halves = hashed.selectExpr(*kept, *[f"{half_sql('_hash', h)} as _h{h}" for h in range(HALVES)])
        return halves.selectExpr(*kept, *[
            f"{limb_sql(f'_h{h}', i) if is_source == (s == 's') else '0L'} as _d{h}{i}{s}"
            for h in range(HALVES) for i in range(LIMBS) for s in "st"])

    seeds = local_rows(
        spark, [(i, p.source_table, p.dest_table, 0, 0) for i, p in enumerate(pairs)],
        pa.schema([("pair", pa.int64()), ("source_table", pa.string()), ("dest_table", pa.string()),
                   ("source", pa.int64()), ("dest", pa.int64())]))
    limbs = [f"_d{h}{i}{s}" for h in range(HALVES) for i in range(LIMBS) for s in "st"] if digest else []
    seeds = seeds.selectExpr("*", *[f"cast(null as bigint) as _max{i}" for i in range(slots)], *[f"0L as {c}" for c in limbs])
    rows = union_all([seeds] + [side(i, p, df, is_src) for i, p in enumerate(pairs) for df, is_src in ((p.source, True), (p.dest, False))])
    totals = rows.groupBy(*NUMBERED).agg(*[
        F.expr(f"{'max' if c.startswith('_max') else 'sum'}({c}) as {c}") for c in rows.columns if c not in NUMBERED])
    if not digest:
        return totals
    values = [
        digest_value([F.col(f"_d{h}{i}{s}") for i in range(LIMBS)]).cast("string").alias(f"{side_name}_{half_name}")
        for s, side_name in (("s", "source"), ("t", "dest")) for h, half_name in enumerate(("high", "low"))]
    return totals.select(*[c for c in totals.columns if c not in limbs], *values)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- row count ---------------------------------------------------------------------------------------

def count_columns(
    source: Column, dest: Column, floor: int = fixed.COUNT_TOLERANCE_FLOOR,
    fraction: float = fixed.COUNT_TOLERANCE_FRACTION, strict: bool = False,
) -> dict[str, Column]:
    """Verdict columns for two row counts; ``strict`` allows no difference."""
    delta = dest - source
    tolerance = F.lit(0).cast("bigint") if strict else F.greatest(
        F.lit(floor).cast("bigint"), F.floor(source.cast("double") * F.lit(float(fraction))).cast("bigint"))
    within = F.abs(delta) <= tolerance
    texts = [thousands(source), thousands(dest)]
    extended = [*texts, signed_thousands(delta), thousands(tolerance)]
    detail = (
        F.when(delta == 0, F.format_string(fixed.COUNT_EXACT, *texts))
        .when(within, F.format_string(fixed.COUNT_TOLERATED, *extended))
        .otherwise(F.format_string(fixed.COUNT_MISMATCH, *extended)))
    return {"delta": delta, "tolerance": tolerance, "exact_match": delta == 0, "passed": within, "detail": detail}


def row_count(pairs: Sequence[TablePair], **limits) -> DataFrame:
    verdict = count_columns(F.col("source"), F.col("dest"), **limits)
    return pair_totals(pairs).select(*PAIR, "source", "dest", *[c.alias(n) for n, c in verdict.items()])


# --- full digest --------------------------------------------------------------------------------------

def _digest_verdict() -> dict[str, Column]:
    same = F.expr("source = dest and source_high = dest_high and source_low = dest_low")
    return {
        "passed": same,
        "detail": F.when(same, F.format_string("%s rows, digests match", thousands(F.col("source")))).otherwise(
            F.format_string("MISMATCH: digests differ (source=%s dest=%s rows)",
                            thousands(F.col("source")), thousands(F.col("dest")))),
    }


def full_hash(pairs: Sequence[TablePair]) -> DataFrame:
    """Order-free digest of all rows on both sides; equal multisets of rows give equal digests."""
    return pair_totals(pairs, digest=pairs).select(
        *PAIR, "source", "dest", "source_high", "source_low", "dest_high", "dest_low",
        *[c.alias(n) for n, c in _digest_verdict().items()])


# --- sampled hashes -----------------------------------------------------------------------------------

def sample_keys(df: DataFrame, key: Sequence[str], seed: str = "0", columns: Sequence[str] | None = None) -> DataFrame:
    """The repeatable key sample of a table: 1 % of the rows, at least 100, at most 1000."""
    names = tuple(columns if columns is not None else df.columns)
    found = samples([Sampled(0, df, tuple(key), names)], seed)
    keys = df.select(*[quoted(k) for k in key], F.expr(hash_sql(df, key)).alias("_match")).join(
        F.broadcast(found.select(F.col("match").alias("_match"), "rn", "row_hash")), "_match").drop("_match")
    return keys.distinct().select(*[quoted(k) for k in key], F.col("rn").cast("bigint").alias("rn"), "row_hash")


def hash_sample(pairs: Sequence[TablePair], seed: str = "0") -> DataFrame:
    """Compare a sample of source rows with the destination rows of the same keys.

    All pairs are sampled in one pass over the sources and compared in one over the destinations. ``skipped`` is true where
    there is no key to sample by, ``checked`` is 0 where there was no row. Rows that exist only on the destination are not
    seen; :func:`tidemark.operators.rowdiff.row_diff` covers those.
    """
    return _hash_samples(list(enumerate(pairs)), seed).drop("pair")


def _hash_samples(numbered: Sequence[tuple[int, TablePair]], seed: str) -> DataFrame:
    spark = numbered[0][1].source.sparkSession
    keyed = [(i, p) for i, p in numbered if p.key]
    names = local_rows(
        spark, [(i, p.source_table, p.dest_table, ", ".join(p.key) or None) for i, p in numbered], numbered_schema(("pk_column", pa.string())))
    if keyed:
        found = compared([Sampled(i, p.source, p.key, tuple(p.compared())) for i, p in keyed], [p.dest for _, p in keyed], seed)
    else:
        found = spark.createDataFrame(
            [], "pair bigint, sample_size bigint, missing_count bigint, mismatched_count bigint, missing array<string>, mismatched array<string>")
    parts = F.concat_ws(
        ", ",
        F.when(F.col("missing_count") > 0, F.format_string(fixed.SAMPLE_MISSING, "missing_count")),
        F.when(F.col("mismatched_count") > 0, F.format_string(fixed.SAMPLE_CHANGED, "mismatched_count")))
    skipped, empty = F.col("pk_column").isNull(), F.col("sample_size") == 0
    passed = skipped | ((F.col("missing_count") == 0) & (F.col("mismatched_count") == 0))
    detail = (
        F.when(skipped, fixed.SAMPLE_NO_KEY).when(empty, fixed.SAMPLE_EMPTY_TABLE)
        .when(passed, F.format_string(fixed.SAMPLE_MATCH, "sample_size"))
        .otherwise(F.format_string(fixed.SAMPLE_MISMATCH, parts, "sample_size")))
    return names.join(found, "pair", "left").select(
        *NUMBERED, passed.alias("passed"), detail.alias("detail"), "sample_size", "missing", "mismatched", "missing_count",
        "mismatched_count", "pk_column", F.when(skipped, True).alias("skipped"), F.when(empty, F.lit(0).cast("bigint")).alias("checked"))


# --- sequences ----------------------------------------------------------------------------------------

def numbered_schema(*more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("pair", pa.int64()), ("source_table", pa.string()), ("dest_table", pa.string()), *more])


def _with_marks(totals: DataFrame, pairs: Sequence[TablePair], marks: DataFrame) -> DataFrame:
    """Pair totals with the number of declared sequences and of those behind their column."""
    declared = local_rows(
        totals.sparkSession,
        [(k, p.source_table, p.dest_table, i, c) for k, p in enumerate(pairs) for i, (c, _) in enumerate(p.sequences)],
        numbered_schema(("slot", pa.int64()), ("column_name", pa.string())))
    last = marks.selectExpr("table_name as dest_table", "column_name", "cast(last_value as bigint) as last_value")
    # a few sequences per table
    per_pair = declared.join(last, ["dest_table", "column_name"], "left").groupBy(*NUMBERED).agg(
        F.collect_list(F.struct("slot", "last_value")).alias("_declared"))
    slots = [c for c in totals.columns if c.startswith("_max")]
    maxima = f"array({', '.join(slots)})" if slots else "cast(array() as array<bigint>)"
    behind = (f"filter(_declared, s -> get({maxima}, cast(s.slot as int)) is not null"
              f" and coalesce(s.last_value < get({maxima}, cast(s.slot as int)), true))")
    return totals.join(per_pair, NUMBERED, "left").selectExpr(
        *totals.columns, "cast(coalesce(array_size(_declared), 0) as bigint) as sequences",
        f"cast(coalesce(array_size({behind}), 0) as bigint) as behind")


def _sequence_verdict() -> dict[str, Column]:
    return {
        "passed": F.col("behind") == 0,
        "detail": F.when(F.col("sequences") == 0, fixed.SEQUENCE_NONE)
        .when(F.col("behind") == 0, F.format_string(fixed.SEQUENCE_OK, "sequences"))
        .otherwise(F.format_string(fixed.SEQUENCE_BEHIND, "behind")),
    }


def sequence_parity(pairs: Sequence[TablePair], marks: DataFrame) -> DataFrame:
    """Every sequence must have reached the largest value of its column.

    ``marks`` has table_name, column_name and last_value.
    """
    found = _with_marks(pair_totals(pairs, maxima=pairs), pairs, marks)
    return found.select(*PAIR, *[c.alias(n) for n, c in _sequence_verdict().items()], "sequences", "behind")


def sequence_states(pairs: Sequence[TablePair], marks: DataFrame) -> DataFrame:
    """Every declared sequence with the largest value of its column and its last value.

    ``ok`` is false for a sequence that is behind its column, or that has no last value although its column has values.
    """
    totals = pair_totals(pairs, maxima=pairs)
    slots = [c for c in totals.columns if c.startswith("_max")]
    declared = local_rows(
        totals.sparkSession,
        [(k, p.source_table, p.dest_table, i, c, s) for k, p in enumerate(pairs) for i, (c, s) in enumerate(p.sequences)],
        numbered_schema(("slot", pa.int64()), ("column_name", pa.string()), ("sequence_name", pa.string())))
    last = marks.selectExpr("table_name as dest_table", "column_name", "cast(last_value as bigint) as last_value")
    largest = f"get(array({', '.join(slots)}), cast(slot as int))" if slots else "cast(null as bigint)"
    return declared.join(last, ["dest_table", "column_name"], "left").join(totals, NUMBERED).selectExpr(
        *PAIR, "column_name", "sequence_name", f"{largest} as max_value", "last_value",
        f"{largest} is null or coalesce(last_value >= {largest}, false) as ok")


# --- all checks of a level ------------------------------------------------------------------------------

RESULT = [*NUMBERED, "position", "name", "passed", "detail", "metrics", "error"]


SAMPLE_METRICS = ["sample_size", "missing", "mismatched", "missing_count", "mismatched_count", "pk_column", "skipped", "checked"]
COUNT_METRICS = ["source", "dest", "delta", "tolerance", "exact_match"]
DIGEST_METRICS = ["source_high", "source_low", "dest_high", "dest_low"]
SEQUENCE_METRICS = ["sequences", "behind"]


def _entry(name: str, verdict: dict[str, Column], metrics: dict[str, Column]) -> Column:
    entries = [x for m, c in metrics.items() for x in (F.lit(m), c.cast("string"))]
    return F.struct(
        F.lit(name).alias("name"), verdict["passed"].alias("passed"), verdict["detail"].alias("detail"),
        F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("metrics"))


def _results(rows: DataFrame, entries: Sequence[Column], pairs: Sequence[TablePair], only: str | None) -> DataFrame:
    """The entries of each pair's row that its level asks for, as rows with their position in the level."""
    wanted = local_rows(
        rows.sparkSession,
        [(k, p.source_table, p.dest_table, i, n) for k, p in enumerate(pairs) for i, n in enumerate(p.checks()) if only in (None, n)],
        numbered_schema(("position", pa.int64()), ("name", pa.string())))
    return rows.select(*NUMBERED, F.inline(F.array(*entries))).join(wanted, [*NUMBERED, "name"]).select(
        *NUMBERED, "position", "name", "passed", "detail", "metrics", F.lit(None).cast("string").alias("error"))


def verify(
    pairs: Sequence[TablePair], marks: DataFrame | None = None, seed: str = "0", only: str | None = None,
) -> DataFrame:
    """All checks of each pair's level, or only the named one; one row per check in the level's order.

    Row counts, digests and sequence maxima of every pair share one pass over its two tables; the samples of all pairs are
    one more.
    """
    spark = pairs[0].source.sparkSession
    if marks is None:
        marks = spark.createDataFrame([], "table_name string, column_name string, last_value bigint")

    def having(name: str) -> list[TablePair]:
        return [p for p in pairs if name in p.checks() and only in (None, name)]

    parts = []
    shared = [n for n in ("row_count", "full_hash", "sequence_parity") if having(n)]
    if shared:
        totals = pair_totals(pairs, digest=having("full_hash"), maxima=having("sequence_parity"))
        totals = _with_marks(totals, pairs, marks)
        count = count_columns(F.col("source"), F.col("dest"))
        entries = []
        if "row_count" in shared:
            entries.append(_entry("row_count", count, {m: count.get(m, F.col(m)) for m in COUNT_METRICS}))
        if "full_hash" in shared:
            entries.append(_entry("full_hash", _digest_verdict(), {m: F.col(m) for m in DIGEST_METRICS}))
        if "sequence_parity" in shared:
            entries.append(_entry("sequence_parity", _sequence_verdict(), {m: F.col(m) for m in SEQUENCE_METRICS}))
        parts.append(_results(totals, entries, pairs, only))
    if having("hash_sample"):
        sampled = _hash_samples([(i, p) for i, p in enumerate(pairs) if any(p is q for q in having("hash_sample"))], seed)
        # an empty table has its size and nothing checked, no lists
        found_rows = F.col("checked").isNull()
        texts = {m: F.to_json(m) if m in ("missing", "mismatched") else F.col(m) for m in SAMPLE_METRICS}
        texts = {m: c if m in ("sample_size", "skipped", "checked") else F.when(found_rows, c) for m, c in texts.items()}
        parts.append(_results(
            sampled, [_entry("hash_sample", {"passed": F.col("passed"), "detail": F.col("detail")}, texts)], pairs, only))
    return union_all(parts).select(*RESULT)


def overall(results: DataFrame) -> DataFrame:
    """Per pair: passed, and the failed checks as one text in check order."""
    failed = F.when(~F.col("passed"), F.struct("position", F.concat_ws(": ", "name", "detail").alias("text")))
    # at most one row per check of a level in each group
    return results.groupBy(*NUMBERED).agg(
        F.min("passed").alias("passed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(failed)), lambda x: x["text"]), "; ").alias("error"),
    ).select(
        *NUMBERED, F.when(F.col("passed"), "passed").otherwise("failed").alias("status"),
        F.when(~F.col("passed"), F.col("error")).alias("error"))
