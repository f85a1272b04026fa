"""Canonical row text, row hashes and order-free digests.

A row's text joins the cells of its columns in name order with the unit separator. Nulls stay
visible and text carries its length, so two different rows never share a text. Equal numbers have one text in all integer and
decimal types, and one in both floating-point types; instants do not depend on the session's zone. The expressions are
built as SQL text: one call into the JVM per row hash however wide the table is.
"""

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

NULL_CELL = r"r'\N'"
CELL_BREAK = "char(31)"
ITEM_BREAK = "char(30)"
FLOAT_SCALE = f"{2 ** 60}D"
FLOAT_FINEST = f"{2.0 ** -36!r}D"
LIMB_BITS = 20
HALVES = 2
LIMBS = 3


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cell_sql(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL text of one cell's canonical text."""
    return f"coalesce({_present(value, dtype, depth)}, {NULL_CELL})"


def _present(value: str, dtype: T.DataType, depth: int) -> str:
    item = f"x{depth}"
    if isinstance(dtype, T.StringType):
        return f"concat(length({value}), ':', {value})"
    if isinstance(dtype, T.BinaryType):
        return f"hex({value})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # adding zero makes one zero of both. A 24-bit mantissa scaled by a power of two is a whole number: exact, and no float
        # printing; a double that no float could hold is printed, in a form that no whole number has
        wide = f"(cast({value} as double) + 0D)"
        return (f"case when {wide} = cast(cast({wide} as float) as double) and ({wide} = 0 or (abs({wide}) >= {FLOAT_FINEST} "
                f"and abs({wide}) < 4)) then cast(cast({wide} * {FLOAT_SCALE} as bigint) as string) else cast({wide} as string) end")
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return f"rtrim('.', rtrim('0', cast({value} as string)))"
    if isinstance(dtype, T.TimestampType):
        # an instant, whatever the session's zone
        return f"concat('@', cast(unix_micros({value}) as string))"
    if isinstance(dtype, T.ArrayType):
        cells = cell_sql(item, dtype.elementType, depth + 1)
        return f"concat('[', concat_ws({ITEM_BREAK}, transform({value}, {item} -> {cells})), ']')" \
               f" || if({value} is null, null, '')"
    if isinstance(dtype, T.StructType):
        cells = [cell_sql(f"{value}.{name_sql(f.name)}", f.dataType, depth) for f in dtype.fields]
        return f"if({value} is null, null, concat('(', concat_ws({ITEM_BREAK}, {', '.join(cells)}), ')'))"
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        cells = cell_sql(item, entry, depth + 1)
        return f"if({value} is null, null, concat('{{', concat_ws({ITEM_BREAK}, " \
               f"array_sort(transform(map_entries({value}), {item} -> {cells}))), '}}'))"
    if isinstance(dtype, T.VariantType):
        return f"to_json({value})"
    return f"cast({value} as string)"


def hash_sql(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns if columns is not None else types)
    return f"md5(concat_ws({CELL_BREAK}, {', '.join(cell_sql(name_sql(n), types[n]) for n in names)}))"


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """md5 of the row text, as 32 hex digits."""
    return F.expr(hash_sql(df, columns))


def half_sql(hash_column: str, half: int) -> str:
    """15 hex digits of a hash as a whole number below 2**60."""
    return f"cast(conv(substring({hash_column}, {1 + 15 * half}, 15), 16, 10) as bigint)"


def limb_sql(half_column: str, limb: int) -> str:
    """20 of the 60 bits of a half.

    Sums of limbs do not depend on row order and, unlike xor, equal rows do not cancel. They stay in
    plain bigint arithmetic for up to 2**43 rows per group.
    """
    return f"(shiftright({half_column}, {LIMB_BITS * limb}) & {(1 << LIMB_BITS) - 1}L)"


def digest_value(limb_sums: Sequence[Column]) -> Column:
    """The exact sum of one 60-bit half from the sums of its three limbs."""
    wide = [s.cast("decimal(20,0)") * F.lit(Decimal(1 << (LIMB_BITS * i))) for i, s in enumerate(limb_sums)]
    return (wide[0] + wide[1] + wide[2]).cast("decimal(38,0)")
