"""Types, casts, canonical text and digests."""

import datetime
import random
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation, localcontext

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from tidemark.functions.canon import row_hash
from tidemark.functions.casts import pg_cast
from tidemark.functions.intervals import INTERVAL
from tidemark.functions.text import mask_credentials, name_of, schema_of
from tidemark.functions.types import native_of, normalize_type, parse_native
from tidemark.operators.verify import TablePair, full_hash

BASES = {
    "string": ["text", "varchar", "character varying", "char", "citext", "name"], "int16": ["smallint", "int2"],
    "int32": ["integer", "int4", "int"], "int64": ["bigint", "int8"], "float32": ["real", "float4"],
    "float64": ["double precision", "float8"], "decimal": ["numeric", "decimal", "money"], "boolean": ["boolean", "bool"],
    "uuid": ["uuid"], "json": ["json", "jsonb"], "binary": ["bytea"], "date": ["date"], "time": ["time", "timetz"],
    "timestamp": ["timestamp"], "timestamptz": ["timestamptz"], "interval": ["interval"],
}
WITH_LENGTH = {"varchar": "(%d)", "character varying": "(%d)", "char": "(%d)", "numeric": "(%d,1)", "decimal": "(%d)", "timestamptz": "(%d)"}
ODD = [("hstore", "unknown"), ("tsvector", "unknown"), ("public.mood", "unknown"), ("", "unknown")]


def type_words():
    """Every base word as it is, in capitals, padded, with a length where it may have one, and as an array in both notations."""
    for word, bases in BASES.items():
        for k, base in enumerate(bases, 2):
            yield from ((base, word), (base.upper(), word), (f" {base}  ", word), (f"{base}[]", "array"))
            if base in WITH_LENGTH:
                yield base + WITH_LENGTH[base] % k, word
                yield base + WITH_LENGTH[base] % k + "[]", "array"
            if " " not in base:
                yield f"_{base}", "array"
    yield from ODD


WORDS = list(type_words())


def test_type_words(spark):
    df = spark.createDataFrame(WORDS, "native string, word string")
    assert df.filter(normalize_type(F.col("native")) != F.col("word")).collect() == []
    assert [parse_native(n)[0] for n, _ in WORDS] == [w for _, w in WORDS]


def test_native_names():
    assert native_of(T.DecimalType(10, 2)) == "numeric(10,2)"
    assert native_of(T.ArrayType(T.FloatType())) == "real[]"
    assert native_of(T.MapType(T.StringType(), T.LongType())) == "map"


def cast_all(spark, values, dtype, native, safe=False):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype)]))
    return [r[0] for r in df.select(pg_cast(F.col("v"), dtype, native, safe)).collect()]


def test_rounding(spark):
    assert cast_all(spark, [2.5, 3.5, -2.5, 2.4], T.DoubleType(), "integer") == [2, 4, -2, 2]
    halves = [Decimal("2.5"), Decimal("3.5"), Decimal("-2.5")]
    assert cast_all(spark, halves, T.DecimalType(5, 1), "bigint") == [3, 4, -3]
    assert cast_all(spark, [Decimal("1.25")], T.DecimalType(5, 2), "numeric(5,1)") == [Decimal("1.3")]


def test_overflow_fails_or_becomes_null(spark):
    with pytest.raises(PySparkException):
        cast_all(spark, [40000], T.LongType(), "smallint")
    assert cast_all(spark, [40000, 7, None], T.LongType(), "smallint", safe=True) == [None, 7, None]
    assert cast_all(spark, [9.3e18, 1.0, float("nan")], T.DoubleType(), "bigint", safe=True) == [None, 1, None]
    edge = [Decimal(2**63 - 1), Decimal(2**63), Decimal(-2**63)]
    assert cast_all(spark, edge, T.DecimalType(20, 0), "bigint", safe=True) == [2**63 - 1, None, -2**63]


def test_text_targets(spark):
    assert cast_all(spark, ["abcdef", "ab", None], T.StringType(), "varchar(3)") == ["abc", "ab", None]
    assert cast_all(spark, ["ab"], T.StringType(), "char(4)") == ["ab  "]
    numbers = [5.0, 2.5, 0.0, 1234567890.0, 1e20, 1.5e-7, 100.0]
    assert cast_all(spark, numbers, T.DoubleType(), "text") == ["5", "2.5", "0", "1234567890", "1e+20", "1.5e-07", "100"]
    assert cast_all(spark, [True], T.BooleanType(), "text") == ["true"]


def test_boolean_uuid_json(spark):
    assert cast_all(spark, [" ON ", "f", "Yes", None], T.StringType(), "boolean") == [True, False, True, None]
    with pytest.raises(PySparkException):
        cast_all(spark, ["maybe"], T.StringType(), "boolean")
    raw = "{A0EEBC99-9C0B4EF8-BB6D6BB9BD380A11}"
    assert cast_all(spark, [raw], T.StringType(), "uuid") == ["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"]
    assert cast_all(spark, ["x", "{}"], T.StringType(), "jsonb", safe=True) == [None, "{}"]


def test_other_targets(spark):
    assert cast_all(spark, ["2024-02-03"], T.StringType(), "date") == [datetime.date(2024, 2, 3)]
    assert cast_all(spark, [[1.5, 2.5]], T.ArrayType(T.DoubleType()), "int4[]") == [[2, 2]]
    assert [bytes(b) for b in cast_all(spark, ["\\x0aff", "hi"], T.StringType(), "bytea")] == [b"\x0a\xff", b"hi"]
    with pytest.raises(ValueError):
        pg_cast(F.lit(1), T.LongType(), "my_enum")


def hashes(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(row_hash(df)).collect()]


def test_different_rows_have_different_text(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("\\N", "ab"), ("a\x1f1:b", ""), ("a", "b\x1f"), (None, None), ("", "")]
    found = hashes(spark, rows, "x string, y string")
    assert len(set(found)) == len(rows)


def test_nested_cells(spark):
    rows = [([1.0, None],), ([1.0],), ([],), (None,), ([None, 1.0],), ([0.1],), ([1e-20],), ([5e7],)]
    found = hashes(spark, rows, "x array<float>")
    assert len(set(found)) == len(rows)
    maps = hashes(spark, [({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({},), (None,)], "x map<string,int>")
    assert maps[0] == maps[1] and len(set(maps)) == 3
    structs = hashes(spark, [((1, None),), ((None, 1),), ((None, None),), (None,)], "x struct<a:int,b:int>")
    assert len(set(structs)) == 4


def test_column_order_does_not_matter(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    assert df.select(row_hash(df)).collect() == df.select("a", "b").select(row_hash(df.select("a", "b"))).collect()


def test_digest_ignores_order_and_sees_repeats(spark):
    def passed(a, b):
        left, right = (spark.createDataFrame(x, "k int, v string") for x in (a, b))
        return full_hash([TablePair("a", "b", left, right)]).collect()[0]["passed"]

    rows = [(i, f"v{i}") for i in range(50)]
    assert passed(rows, rows[::-1])
    assert not passed(rows + [rows[0]] * 2, rows + [rows[1]] * 2)
    assert not passed(rows, rows[:-1])


def test_names(spark):
    df = spark.createDataFrame([("posts",), ("a.b",), ("a.b.c",)], "q string")
    assert [tuple(r) for r in df.select(schema_of(F.col("q")), name_of(F.col("q"))).collect()] == [
        ("public", "posts"), ("a", "b"), ("a", "b.c")]
    urls = spark.createDataFrame([("redis://u:p@h:1/0",), ("http://h/p@x",)], "u string")
    assert [r[0] for r in urls.select(mask_credentials(F.col("u"))).collect()] == ["redis://***@h:1/0", "http://h/p@x"]


def test_equal_numbers_of_different_types_hash_alike(spark):
    def of(sql):
        df = spark.sql(f"select {sql} as v")
        return df.select(row_hash(df)).first()[0]

    for same in (["1", "1L", "1.00", "cast(1 as smallint)", "cast(1 as decimal(30,9))"], ["0.5F", "0.5D"], ["-0.0D", "0.0D", "0.0F"],
                 ["1.50", "1.5"], ["5e7F", "5e7D"], ["1000", "1000.0", "1e3BD"]):
        assert len({of(x) for x in same}) == 1, same
    assert len({of(x) for x in ("0.1F", "0.1D", "1", "10", "100", "1.5", "1.05", "3e9D", "4D", "4.5D", "-1")}) == 11


def test_instants_and_zones(spark):
    """Two instants that share a wall clock at the end of summer time, hashed and printed under two zones."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = {}
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("select timestamp_micros(m) as v from values (1730611800000000), (1730615400000000) t(m)")
            found[name] = (
                [r[0] for r in df.select(row_hash(df)).collect()],
                [r[0] for r in df.select(pg_cast(F.col("v"), T.TimestampType(), "text")).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found["UTC"] == found["America/New_York"] and len(set(found["UTC"][0])) == 2
    assert found["UTC"][1] == ["2024-11-03 05:30:00+00", "2024-11-03 06:30:00+00"]


def test_real_text_and_unbounded_numeric(spark):
    assert cast_all(spark, [1e6, 123456.0, 999999.0, 0.5, -1234567.5, 2.5e6, 3e8], T.FloatType(), "text") == [
        "1e+06", "123456", "999999", "0.5", "-1.2345675e+06", "2.5e+06", "3e+08"]
    assert cast_all(spark, ["1.25", "1e-19", "0.0000000000000000001", None], T.StringType(), "numeric", safe=True) == [
        Decimal("1.25"), None, None, None]
    assert cast_all(spark, [0.5, 1e-30, 1e30], T.DoubleType(), "numeric", safe=True) == [Decimal("0.5"), None, None]
    with pytest.raises(PySparkException, match="cannot hold"):
        cast_all(spark, ["0.1234567890123456789"], T.StringType(), "numeric")


def test_moments_of_less_precision(spark):
    stamp = datetime.datetime(2024, 1, 2, 3, 4, 5, 678_500)
    assert cast_all(spark, [stamp], T.TimestampNTZType(), "timestamp(3)") == [datetime.datetime(2024, 1, 2, 3, 4, 5, 679_000)]
    assert cast_all(spark, [stamp], T.TimestampNTZType(), "timestamp(0)") == [datetime.datetime(2024, 1, 2, 3, 4, 6)]
    early = datetime.datetime(1969, 12, 31, 23, 59, 59, 999_600)
    assert cast_all(spark, [early, None], T.TimestampNTZType(), "timestamp(3)") == [datetime.datetime(1970, 1, 1), None]


def test_interval_texts(spark):
    """Values that PostgreSQL documents or that follow from its rules."""
    want = {
        "1 year 2 mons -3 days 04:05:06.789": ((14, -3, 14_706_789_000), "1 year 2 mons -3 days +04:05:06.789"),
        "P1Y2M3DT4H5M6S": ((14, 3, 14_706_000_000), "1 year 2 mons 3 days 04:05:06"), "1.5 months": ((1, 15, 0), "1 mon 15 days"),
        "1.5 years ago": ((-18, 0, 0), "-1 years -6 mons"), "1.5 weeks": ((0, 10, 43_200_000_000), "10 days 12:00:00"),
        "-1 day +02:00": ((0, -1, 7_200_000_000), "-1 days +02:00:00"), "@ 3 hours 1": ((0, 0, 10_801_000_000), "03:00:01"),
        "1D12h": ((0, 1, 43_200_000_000), "1 day 12:00:00"), "-0.5 days": ((0, 0, -43_200_000_000), "-12:00:00"),
        "100:00:00": ((0, 0, 360_000_000_000), "100:00:00"), "0": ((0, 0, 0), "00:00:00"), "PT0.5S": ((0, 0, 500_000), "00:00:00.5")}
    bad = ["", "abc", "1 foo", "1 2", "1 day x", "99999999999 years", "p"]
    texts = list(want) + bad + [None]
    values = cast_all(spark, texts, T.StringType(), "interval", safe=True)
    assert [v and tuple(v) for v in values] == [w[0] for w in want.values()] + [None] * (len(bad) + 1)
    assert cast_all(spark, [w[0] for w in want.values()] + [None], INTERVAL, "text") == [w[1] for w in want.values()] + [None]
    assert tuple(cast_all(spark, ["1.2345 s"], T.StringType(), "interval(2)")[0]) == (0, 0, 1_230_000)
    with pytest.raises(Exception, match="invalid input for interval: abc"):
        cast_all(spark, ["abc"], T.StringType(), "interval")
    day = cast_all(spark, [datetime.timedelta(days=-1, seconds=-5)], T.DayTimeIntervalType(), "interval")
    assert tuple(day[0]) == (0, -1, -5_000_000)


@pytest.mark.parametrize("precision, scale", [(50, 2), (45, 0), (60, 40)])
def test_numbers_beyond_38_digits(spark, precision, scale):
    rng = random.Random(precision)
    texts = ["1e41", "1e-3", "-0.001", ".5", "007.125", "9.995", "-9.995", "0", "9" * 40 + ".996", "1e60", "x", "", "1e", "1.2.3"]
    texts += ["".join(rng.choice("0159") for _ in range(rng.randint(1, 30))) + "." + "".join(rng.choice("459") for _ in range(rng.randint(0, 60)))
              + rng.choice(["", "", "e5", "e-7", "E+12"]) for _ in range(150)]
    want = []
    with localcontext() as context:
        context.prec = 300
        for text in texts:
            try:
                number = Decimal(text).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
            except InvalidOperation:
                want.append(None)
                continue
            number = abs(number) if number == 0 else number
            want.append(format(number, "f") if abs(number) < Decimal(10) ** (precision - scale) else None)
    assert cast_all(spark, texts, T.StringType(), f"numeric({precision},{scale})", safe=True) == want
    assert cast_all(spark, ["NaN", None], T.StringType(), f"numeric({precision},{scale})", safe=True) == ["NaN", None]
    with pytest.raises(Exception, match="no numeric"):
        cast_all(spark, ["x"], T.StringType(), f"numeric({precision},{scale})")


def test_short_times(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        df = spark.createDataFrame([("01:02:03.456789",), ("23:59:59.9994",), ("00:00:00.0005",), ("23:59:59.9996",), (None,)], "v string")
        found = df.select(pg_cast(F.col("v"), T.StringType(), "time(3)", True).cast("string").alias("t"))
        assert [r.t for r in found.collect()] == ["01:02:03.457", "23:59:59.999", "00:00:00.001", None, None]
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")
