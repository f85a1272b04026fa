"""Interval values as months, days and microseconds, read from and written as PostgreSQL's text.

Spark's own calendar intervals cannot be stored in files or compared, so the three parts are a struct.
"""

from pyspark.sql import Column, functions as F, types as T

from tidemark.fixed_values import INTERVAL_UNITS

INTERVAL = T.StructType([
    T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("microseconds", T.LongType())])
DAY_MICROS = 86_400_000_000
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
_CLOCK = r"[+-]?\d+:\d+(?::\d+(?:\.\d+)?)?"
_SHAPE = rf"^@?\s*(?:(?:{_CLOCK}|{_NUMBER}\s*[a-z]+)(?:\s+|(?=[+-])|(?<=[a-z])(?=\d)|$))*(?:{_NUMBER})?$"
_WIDE = "decimal(38,9)"


def _unit_place(unit: Column) -> Column:
    """The place of a unit's word in the list of units, or null."""
    place = F.lit(None).cast("int")
    for at, (words, _, _) in reversed(list(enumerate(INTERVAL_UNITS))):
        place = F.when(unit.isin(words), at).otherwise(place)
    return place


def _unit_sizes(part: str) -> Column:
    """How many months, days or microseconds the units have, in their order; null for units of other parts."""
    return F.expr("array(" + ", ".join(f"{n}L" if kind == part else "cast(null as bigint)" for _, kind, n in INTERVAL_UNITS) + ")")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; written out, it would be computed wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(value: Column) -> Column:
    """Without its fraction, towards zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast(_WIDE)


def _total(parts: Column, name: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast(_WIDE), lambda total, x: (total + x[name]).cast(_WIDE))


def _clock(clock: Column) -> Column:
    """A time of ``parse_interval`` as months, days and microseconds."""
    def micros(parts: Column) -> Column:
        second = F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).cast(_WIDE)
        size = ((F.get(parts, F.lit(0)).cast(_WIDE) * 3600 + F.get(parts, F.lit(1)).cast(_WIDE) * 60 + second) * 1_000_000)
        return F.when(clock.startswith("-"), -size).otherwise(size).cast(_WIDE)

    zero = F.lit(0).cast(_WIDE)
    return F.struct(zero.alias("months"), zero.alias("days"),
                    let(F.split(F.regexp_replace(clock, "^[+-]", ""), ":"), micros).alias("micros"))


def _quantities(numbers: Column, units: Column) -> Column:
    """Numbers with units as months, days and microseconds; null parts where a unit is unknown."""
    measured = F.zip_with(numbers, units, lambda number, unit: let(
        _unit_place(F.when(unit == "", "s").otherwise(unit)), lambda place: F.struct(
            number.cast("decimal(28,9)").alias("q"),
            *[F.get(_unit_sizes(p), place).alias(p) for p in ("months", "days", "microseconds")])))

    def spread(x: Column) -> Column:
        months = x["q"] * x["months"]
        known = F.coalesce(x["months"], x["days"], x["microseconds"]).isNotNull()
        days = F.coalesce(x["q"] * x["days"], F.when(x["months"] == 1, (x["q"] - _cut(x["q"])) * 30), F.when(known, 0)).cast(_WIDE)
        return F.struct(
            F.when(x["months"] > 1, F.round(months, 0)).when(x["months"] == 1, _cut(months)).when(known, 0).cast(_WIDE).alias("months"),
            days.alias("days"), F.coalesce(x["q"] * x["microseconds"], F.when(known, 0)).cast(_WIDE).alias("micros"))

    return F.transform(F.transform(measured, spread), lambda x: F.struct(
        x["months"].alias("months"), _cut(x["days"]).alias("days"),
        F.round((x["days"] - _cut(x["days"])) * DAY_MICROS + x["micros"], 0).cast(_WIDE).alias("micros")))


def parse_interval(text: Column, digits: int = 6) -> Column:
    """An interval's parts, or null for text that is none.

    Read are quantities with units (``1 year 2 mons -3.5 days``, also without blanks), times (``04:05:06.7``), a last number
    without unit as seconds, ``ago``, and ISO 8601 with designators (``P1Y2M3DT4H5M6S``). Fractions of years and longer units
    are rounded to months; those of months count 30 days a month, those of days and weeks go to the time. Not read are
    ``1-2`` as years and months and ISO's form without designators. ``digits`` of a second are kept.
    """
    def worded(plain: Column) -> Column:
        before = F.regexp_replace(F.regexp_extract(plain, r"^p([^t]*)", 1), "m", "mon")
        return F.when(plain.rlike(r"^p(?=[\dt+-])"), F.concat_ws(" ", before, F.regexp_extract(plain, "t(.*)$", 1))).otherwise(
            F.regexp_replace(plain, "^@", ""))

    def summed(body: Column) -> Column:
        found = rf"({_NUMBER})\s*([a-z]*)"
        return let(F.regexp_replace(body, r"\s*ago$|^\s+", ""), lambda plain: let(F.regexp_replace(plain, _CLOCK, " "), lambda rest: let(
            F.concat(
                F.transform(F.regexp_extract_all(plain, F.lit(f"({_CLOCK})"), F.lit(1)), _clock),
                _quantities(F.regexp_extract_all(rest, F.lit(found), F.lit(1)), F.regexp_extract_all(rest, F.lit(found), F.lit(2)))),
            lambda parts: F.when(plain.rlike(_SHAPE) & (F.size(parts) > 0), F.struct(
                F.when(body.rlike(r"ago$"), -1).otherwise(1).alias("sign"),
                *[_total(parts, n).alias(n) for n in ("months", "days", "micros")])))))

    def shaped(total: Column) -> Column:
        micros = total["micros"] * total["sign"]
        if digits < 6:
            micros = F.round(micros / 10 ** (6 - digits), 0) * 10 ** (6 - digits)
        parts = F.struct((total["months"] * total["sign"]).try_cast("int").alias("months"),
                         (total["days"] * total["sign"]).try_cast("int").alias("days"), micros.try_cast("bigint").alias("microseconds"))
        return let(parts, lambda p: F.when(p["months"].isNotNull() & p["days"].isNotNull() & p["microseconds"].isNotNull(), p))

    return let(let(let(F.lower(F.trim(text)), worded), summed), shaped).cast(INTERVAL)


def interval_text(value: Column) -> Column:
    """The text of an interval's parts: ``1 year 2 mons -3 days +04:05:06.7``."""
    def part(n: Column, word: str, after: Column) -> Column:
        sign = F.when(after & (n > 0), "+").otherwise("")
        return F.when(n != 0, F.concat(sign, n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))

    def written(v: Column) -> Column:
        months, days, micros, size = v["months"], v["days"], v["microseconds"], F.abs(v["microseconds"])
        years = F.when(months < 0, F.ceil(months / 12)).otherwise(F.floor(months / 12)).cast("int")
        hours, minutes = F.floor(size / 3_600_000_000), F.floor(size / 60_000_000) % 60
        second = F.regexp_replace(
            F.format_string("%02d.%06d", F.floor(size / 1_000_000) % 60, size % 1_000_000), r"\.?0{1,6}$", "")
        second = F.when(size % 1_000_000 == 0, F.format_string("%02d", F.floor(size / 1_000_000) % 60)).otherwise(second)
        negative = F.when(days != 0, days < 0).otherwise(months < 0)
        clock = F.when((micros != 0) | ((months == 0) & (days == 0)), F.concat(
            F.when(micros < 0, "-").when(negative & (micros > 0), "+").otherwise(""),
            F.format_string("%02d:%02d:", hours, minutes), second))
        return F.concat_ws(
            " ", part(years, "year", F.lit(False)), part(months - years * 12, "mon", years < 0), part(days, "day", months < 0), clock)

    return F.when(value.isNotNull(), let(value, written))
