"""Complete keyed comparison of two tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.canon import LIMBS, cell_sql, half_sql, hash_sql, limb_sql, name_sql
from tidemark.functions.text import quoted
from tidemark.sources.storage import stored

#: Ranges of key hashes on the first and on the second level, as leading bits of 60.
COARSE_BITS = 12
FINE_BITS = 18


def _compared(src: DataFrame, dst: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = list(columns) if columns is not None else src.columns
    absent = [n for n in names if n not in dst.columns or n not in src.columns]
    if absent:
        raise ValueError(f"columns not on both sides: {', '.join(absent)}")
    return names


def row_diff(
    src: DataFrame, dst: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every key with its class: match, mismatched, missing_in_dest or missing_in_source.

    Both sides pass through one shuffle on the key, pre-aggregated per task. A repeated key is compared
    as a multiset: same number of rows and same digest on both sides.
    """
    names = _compared(src, dst, columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        # hash, number and limbs are projected one after the other, so each is computed once per row
        hashed = df.selectExpr(*keys, f"{hash_sql(df, names)} as _hash")
        numbers = hashed.selectExpr(*keys, f"{half_sql('_hash', 0)} as _half")
        return numbers.selectExpr(
            *keys, f"{int(sign > 0)}L as source_rows", f"{int(sign < 0)}L as dest_rows",
            *[f"{limb_sql('_half', i)} * {sign} as _d{i}" for i in range(LIMBS)])

    keys = [name_sql(k) for k in key]
    per_key = side(src, 1).unionByName(side(dst, -1)).groupBy(*[quoted(k) for k in key]).agg(*[
        F.expr(f"sum({c}) as {c}") for c in ("source_rows", "dest_rows", *[f"_d{i}" for i in range(LIMBS)])])
    status = (
        F.when(F.col("dest_rows") == 0, "missing_in_dest")
        .when(F.col("source_rows") == 0, "missing_in_source")
        .when(F.expr("source_rows = dest_rows and _d0 = 0 and _d1 = 0 and _d2 = 0"), "match")
        .otherwise("mismatched")
    )
    return per_key.select(*[quoted(k) for k in key], "source_rows", "dest_rows", status.alias("status"))


def row_diff_summary(diff: DataFrame) -> DataFrame:
    """Keys and rows per class, all four classes in one row."""
    def keys(status: str):
        return F.count_if(F.col("status") == status).alias(status)

    return diff.agg(
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("dest_rows"), F.lit(0)).alias("dest_rows"),
        keys("match"), keys("mismatched"), keys("missing_in_dest"), keys("missing_in_source"),
    )


def column_changes(
    src: DataFrame, dst: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """Per column, how many keys hold a different value on the two sides.

    Only keys with one row on each side are compared: with repeated keys there is no pairing of rows.
    Two equal cell hashes cancel under xor, so one aggregation finds the changes without a join.
    """
    names = [n for n in _compared(src, dst, columns) if n not in key]
    plain = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.BinaryType, T.TimestampNTZType)

    def cell(df: DataFrame, name: str) -> str:
        # both sides hash the same form: the value itself where its type has one form only, else the canonical text
        if src.schema[name].dataType == dst.schema[name].dataType and isinstance(src.schema[name].dataType, plain):
            return f"xxhash64({name_sql(name)} is null, {name_sql(name)})"
        return f"xxhash64({cell_sql(name_sql(name), df.schema[name].dataType)})"

    def side(df: DataFrame, is_source: int) -> DataFrame:
        return df.selectExpr(
            *[name_sql(k) for k in key], f"{is_source}L as _s",
            *[f"{cell(df, n)} as _c{i}" for i, n in enumerate(names)])

    per_key = side(src, 1).unionByName(side(dst, 0)).groupBy(*[quoted(k) for k in key]).agg(
        F.sum("_s").alias("_s"), F.count("*").alias("_n"),
        *[F.bit_xor(f"_c{i}").alias(f"_c{i}") for i in range(len(names))])
    counts = per_key.filter("_s = 1 and _n = 2").agg(
        *[F.count_if(F.col(f"_c{i}") != 0).alias(n) for i, n in enumerate(names)])
    return counts.unpivot([], [quoted(n) for n in names], "column_name", "changed_keys")


def _with_key_hash(df: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The columns that are compared, with the leading FINE_BITS bits of the key's canonical hash as ``_range``."""
    needed = [name_sql(n) for n in dict.fromkeys([*key, *names])]
    return df.selectExpr(*needed, f"{hash_sql(df, key)} as _key_hash").selectExpr(
        *needed, f"shiftright({half_sql('_key_hash', 0)}, {60 - FINE_BITS}) as _range")


def range_digests(sides: Sequence[DataFrame], names: Sequence[str], bits: int) -> DataFrame:
    """(range, source_rows, dest_rows) of the ranges of ``bits`` bits whose digests differ between two sides with ``_range``.

    Every task sums the row hashes of its ranges, so what is shuffled is at most 2 ** bits short rows a task, however many rows
    there are. Two sides with equal rows in a range have equal sums.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        at = f"shiftright(_range, {FINE_BITS - bits}) as range"
        hashed = df.selectExpr(at, f"{hash_sql(df, names)} as _hash").selectExpr("range", f"{half_sql('_hash', 0)} as _half")
        return hashed.selectExpr(
            "range", f"{int(sign > 0)}L as source_rows", f"{int(sign < 0)}L as dest_rows",
            *[f"{limb_sql('_half', i)} * {sign} as _d{i}" for i in range(LIMBS)])

    sums = side(sides[0], 1).unionByName(side(sides[1], -1)).groupBy("range").agg(*[
        F.expr(f"sum({c}) as {c}") for c in ("source_rows", "dest_rows", *[f"_d{i}" for i in range(LIMBS)])])
    return sums.filter("source_rows <> dest_rows or _d0 <> 0 or _d1 <> 0 or _d2 <> 0").select("range", "source_rows", "dest_rows")


def row_diff_ranges(
    src: DataFrame, dst: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """The keys of row_diff that are no match, found by drilling down a tree of digests.

    Digests over 4096 ranges of key hashes are compared first, then those over the 64 parts of each range that differs; only
    rows in parts that differ are shuffled and compared by key. Where few rows differ nearly nothing is shuffled, at the price
    of reading both sides up to three times; where most ranges differ, row_diff reads them once.
    """
    names = _compared(src, dst, columns)
    sides = [_with_key_hash(df, key, names) for df in (src, dst)]
    # at most 4096 numbers
    coarse = sorted(r["range"] for r in range_digests(sides, names, COARSE_BITS).collect())
    differs = set(coarse)
    flags = F.split(F.lit(",".join("1" if k in differs else "0" for k in range(1 << COARSE_BITS))), ",")
    open_sides = [df.filter(F.get(flags, F.shiftright("_range", FINE_BITS - COARSE_BITS).cast("int")) == "1") for df in sides]
    if not coarse:
        open_sides = [df.limit(0) for df in sides]
    # at most 2 ** 18 numbers
    fine, _ = stored(range_digests(open_sides, names, FINE_BITS).select(F.col("range").alias("_range")), "ranges")
    left = [df.join(F.broadcast(fine), "_range", "left_semi").drop("_range") for df in open_sides]
    return row_diff(left[0], left[1], key, names).filter("status <> 'match'")
