"""Casts that give the values a PostgreSQL ``::type`` would give.

Spark's own cast differs where it truncates fractions, keeps over-long varchars and prints whole
doubles with a trailing ``.0``; those cases are corrected first, the rest is Spark's cast. With
``safe`` a value that cannot be cast becomes null instead of failing the job.
"""

from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.intervals import INTERVAL, interval_text, let, parse_interval
from tidemark.functions.types import parse_native

INT_TYPES = {"int16": "smallint", "int32": "int", "int64": "bigint"}
INT_RANGES = {"int16": (-2**15, 2**15 - 1), "int32": (-2**31, 2**31 - 1), "int64": (-2**63, 2**63 - 1)}
TRUE_WORDS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_WORDS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]


def pg_cast(value: Column, source: T.DataType, native: str, safe: bool = False) -> Column:
    word, base, params = parse_native(native)
    if word == "array":
        return _to_array(value, source, native, safe)
    build = _BUILDERS.get(word)
    if build is None:
        raise ValueError(f"no cast from {source.simpleString()} to {native}")
    return build(value, source, base, params, safe)


def spark_type(native: str, source: T.DataType) -> T.DataType | str:
    """Spark type a column of this native type has after :func:`pg_cast`."""
    word, _, params = parse_native(native)
    if word == "decimal":
        return _decimal_type(source, params)
    return {"string": "string", **INT_TYPES, "float32": "float", "float64": "double", "boolean": "boolean",
            "uuid": "string", "json": "string", "binary": "binary", "date": "date", "time": "time(6)",
            "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "interval": INTERVAL}[word]


def number_text(value: Column, single: bool = False) -> Column:
    """Text of a float or double: no trailing ``.0``, exponent only outside 1e-4 .. 1e15, or 1e6 in single precision."""
    plain = F.regexp_replace(value.cast("string").try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    raw = value.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^([^E]+)", 1), r"\.0$", "")
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    if single:
        # Spark writes singles below 1e7 without an exponent
        digits = F.regexp_replace(F.regexp_replace(plain, "[-.]", ""), "0+$", "")
        short = F.concat(
            F.when(value < 0, "-").otherwise(""), F.substring(digits, 1, 1),
            F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise(""), F.lit("e+06"))
        scientific = F.when(F.abs(value) < 1e7, F.when(F.abs(value) >= 1e6, short).otherwise(scientific)).otherwise(scientific)
    size = F.abs(value)
    return (
        F.when(value == 0, "0")
        .when((size >= 1e-4) & (size < (1e6 if single else 1e15)), plain)
        .otherwise(F.coalesce(scientific, raw))
    )


def _cast(value, target, safe):
    return value.try_cast(target) if safe else value.cast(target)


def _reject(message: str, value: Column, target: str, safe: bool) -> Column:
    if safe:
        return F.lit(None).cast(target)
    return F.raise_error(F.concat(F.lit(message + ": "), value.cast("string"))).cast(target)


def _text(value, source):
    if isinstance(source, (T.FloatType, T.DoubleType)):
        return number_text(value, isinstance(source, T.FloatType))
    if isinstance(source, T.TimestampType):
        return F.concat(_of_micros(F.unix_micros(value)).cast("string"), F.lit("+00"))
    if isinstance(source, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(source, T.VariantType):
        return F.to_json(value)
    if source == INTERVAL:
        return interval_text(value)
    return value.cast("string")


def _to_string(value, source, base, params, safe):
    text = _text(value, source)
    if base in ("char", "character"):
        width = params[0] if params else 1
        return F.rpad(F.substring(text, 1, width), width, " ")
    return F.substring(text, 1, params[0]) if params else text


def _to_int(word):
    def build(value, source, base, params, safe):
        if isinstance(source, (T.FloatType, T.DoubleType)):
            value = F.rint(value)
        elif isinstance(source, T.DecimalType):
            value = F.round(value, 0)
        if safe and isinstance(source, T.NumericType):
            # a range test is far cheaper than a cast that fails on many rows
            low, high = INT_RANGES[word]
            fractional = isinstance(source, (T.FloatType, T.DoubleType))
            below = value < float(high + 1) if fractional else value <= high
            return F.when((value >= low) & below, value.cast(INT_TYPES[word]))
        return _cast(value, INT_TYPES[word], safe)
    return build


def _to_float(target):
    def build(value, source, base, params, safe):
        return _cast(value, target, safe)
    return build


EPOCH = "1970-01-01 00:00:00"
DAY = 86_400_000_000


def _of_micros(micros):
    """The zone-free time that is so many microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH).cast("timestamp_ntz"))


def _decimal_type(source, params):
    if params and params[0] > 38:
        return T.StringType()
    if params:
        return T.DecimalType(params[0], params[1] if len(params) > 1 else 0)
    if isinstance(source, T.DecimalType):
        return source
    return T.DecimalType(38, 0) if isinstance(source, T.IntegralType) else T.DecimalType(38, 18)


def _wide_decimal(value, source, precision, scale, safe):
    """Text of a number of more than 38 digits: rounded to the scale, halves away from zero, without leading zeros.

    Texts with exponents of at most 9999 are read; ``NaN`` stays.
    """
    number = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]{1,4})?$"

    def placed(text: Column) -> Column:
        whole, fraction = F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), F.regexp_extract(text, r"[.]([0-9]*)", 1)
        moved = F.length(whole) + F.when(
            F.contains(text, F.lit("e")), F.regexp_extract(text, "e([+-]?[0-9]+)$", 1).cast("int")).otherwise(0)
        # one digit before the point at least
        return let(moved, lambda point: F.struct(
            F.concat(F.repeat(F.lit("0"), F.greatest(1 - point, F.lit(0))), whole, fraction).alias("digits"),
            F.greatest(point, F.lit(1)).alias("point")))

    def rounded(x: Column) -> Column:
        length = x["point"] + scale
        # the digit behind the scale decides on the rounding
        padded = F.concat(F.lit("0"), x["digits"], F.repeat(F.lit("0"), F.greatest(length + 1 - F.length(x["digits"]), F.lit(0))))
        up = F.substr(padded, length + 2, F.lit(1)) >= "5"
        # one more: the last digit that is no nine goes up, the nines behind it become zeros
        more = lambda kept: F.concat(
            F.regexp_extract(kept, "^(.*?)[0-8]9*$", 1), (F.regexp_extract(kept, "([0-8])9*$", 1).cast("int") + 1).cast("string"),
            F.repeat(F.lit("0"), F.length(F.regexp_extract(kept, "(9*)$", 1))))
        done = let(F.substr(padded, F.lit(1), length + 1), lambda kept: F.when(up, more(kept)).otherwise(kept))
        return let(done, lambda d: F.struct(
            F.regexp_replace(F.substr(d, F.lit(1), x["point"] + 1), "^0+(?=[0-9])", "").alias("before"),
            F.substr(d, x["point"] + 2, F.lit(scale)).alias("after")))

    def written(text: Column) -> Column:
        def joined(x: Column) -> Column:
            fits = F.when(x["before"] == "0", 0).otherwise(F.length(x["before"])) <= precision - scale
            some = F.concat(x["before"], x["after"]).rlike("[1-9]")
            sign = F.when(text.startswith("-") & some, "-").otherwise("")
            return F.when(fits, F.concat(sign, x["before"], F.lit("." if scale else ""), x["after"]))

        return F.when(text == "nan", "NaN").when(text.rlike(number), let(let(placed(text), rounded), joined))

    done = let(F.lower(F.trim(_text(value, source))), written)
    return F.when(value.isNotNull(), F.coalesce(done, _reject(f"no numeric({precision},{scale})", value, "string", safe)))


def _to_decimal(value, source, base, params, safe):
    if params and params[0] > 38:
        return _wide_decimal(value, source, params[0], params[1] if len(params) > 1 else 0, safe)
    target = _decimal_type(source, params)
    done = _cast(value, target, safe)
    if params or isinstance(source, (T.DecimalType, T.IntegralType)):
        return done
    # numeric without parameters keeps every digit; what 38 digits with 18 after the point cannot hold is refused
    if isinstance(source, (T.FloatType, T.DoubleType)):
        kept = done.cast(source) == value
    else:
        digits = F.regexp_replace(F.regexp_extract(F.trim(value.cast("string")), r"[.](\d+)", 1), "0+$", "")
        kept = (F.length(digits) <= target.scale) & ~F.contains(F.lower(value.cast("string")), F.lit("e-"))
    return F.when(value.isNull() | F.coalesce(kept, F.lit(False)), done).otherwise(
        _reject("numeric without parameters cannot hold", value, target, safe))


def _to_boolean(value, source, base, params, safe):
    if not isinstance(source, T.StringType):
        return _cast(value, "boolean", safe)
    word = F.lower(F.trim(value))
    return (
        F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
        .when(value.isNotNull(), _reject("invalid input for boolean", value, "boolean", safe))
    )


def _to_uuid(value, source, base, params, safe):
    digits = F.lower(F.regexp_replace(value.cast("string"), r"[{}-]", ""))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return (
        F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))
        .when(value.isNotNull(), _reject("invalid input for uuid", value, "string", safe))
    )


def _to_json(value, source, base, params, safe):
    if not isinstance(source, T.StringType):
        return F.to_json(value)
    return (
        F.when(F.try_parse_json(value).isNotNull(), value)
        .when(value.isNotNull(), _reject("invalid input for json", value, "string", safe))
    )


def _to_binary(value, source, base, params, safe):
    if isinstance(source, T.BinaryType):
        return value
    return F.when(value.startswith("\\x"), F.unhex(F.substr(value, F.lit(3)))).otherwise(F.encode(value, "UTF-8"))


def _to_date(value, source, base, params, safe):
    return _cast(value, "date", safe)


def _to_moment(target):
    def build(value, source, base, params, safe):
        done = _cast(value, target, safe)
        if not params or params[0] >= 6:
            return done
        unit = 10 ** (6 - params[0])
        if target.startswith("time("):
            # halves up; what rounds to 24:00:00, which a Spark time cannot hold, is refused
            micros = F.time_diff(F.lit("MICROSECOND"), F.lit("00:00:00").cast("time(6)"), done)
            rounded = F.floor((micros + unit // 2) / unit).cast("bigint") * unit
            clock = F.concat_ws(":", *[F.lpad((F.floor(rounded / n) % 60).cast("string"), 2, "0") for n in (3_600_000_000, 60_000_000)],
                                F.format_string("%02d.%06d", F.floor(rounded / 1_000_000) % 60, rounded % 1_000_000))
            return F.when(rounded < 86_400_000_000, clock.try_cast("time(6)")).when(
                done.isNotNull(), _reject(f"{base}({params[0]}) cannot hold 24:00:00", value, target, safe))
        zoned = target == "timestamp"
        micros = F.unix_micros(done) if zoned else F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), done)
        # to the nearest, halves away from 1970
        rounded = F.signum(micros).cast("bigint") * F.floor((F.abs(micros) + unit // 2) / unit).cast("bigint") * unit
        return F.timestamp_micros(rounded) if zoned else _of_micros(rounded)
    return build


def _to_interval(value, source, base, params, safe):
    digits = params[0] if params else 6
    if isinstance(source, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        zero, none = F.lit(EPOCH).cast("timestamp_ntz"), F.lit(0)
        days_only = isinstance(source, T.DayTimeIntervalType)
        months = none if days_only else F.timestamp_diff("MONTH", zero, zero + value)
        micros = F.timestamp_diff("MICROSECOND", zero, zero + value) if days_only else none
        days = F.when(micros < 0, F.ceil(micros / DAY)).otherwise(F.floor(micros / DAY))
        done = F.when(value.isNotNull(), F.struct(
            months.cast("int").alias("months"), days.cast("int").alias("days"), (micros - days * DAY).cast("bigint").alias("microseconds")))
        return done.cast(INTERVAL)
    if source == INTERVAL:
        return value
    if not isinstance(source, T.StringType):
        raise ValueError(f"no cast from {source.simpleString()} to {base}")
    done = parse_interval(value, digits)
    empty = F.lit(None).cast(INTERVAL)
    if safe:
        return done
    failed = F.raise_error(F.concat(F.lit("invalid input for interval: "), value))
    return F.when(value.isNull(), empty).otherwise(F.coalesce(done, failed.cast(INTERVAL)))


def _to_array(value, source, native, safe):
    if not isinstance(source, T.ArrayType):
        raise ValueError(f"no cast from {source.simpleString()} to {native}")
    element = native.strip().lower()
    element = element[:-2] if element.endswith("[]") else element.lstrip("_")
    return F.transform(value, lambda x: pg_cast(x, source.elementType, element, safe))


_BUILDERS = {
    "string": _to_string,
    "int16": _to_int("int16"), "int32": _to_int("int32"), "int64": _to_int("int64"),
    "float32": _to_float("float"), "float64": _to_float("double"),
    "decimal": _to_decimal, "boolean": _to_boolean, "uuid": _to_uuid, "json": _to_json, "binary": _to_binary,
    "date": _to_date, "time": _to_moment("time(6)"),
    "timestamp": _to_moment("timestamp_ntz"), "timestamptz": _to_moment("timestamp"), "interval": _to_interval,
}
