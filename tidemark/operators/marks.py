"""High-water marks: the last value each sequence-backed column has reached."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import quoted
from tidemark.operators.keyed import local_rows, strings, union_all


def column_maxima(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """table_name, column_name, max_value; one pass per table however many columns it has."""
    def one(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        totals = df.agg(*[F.max(quoted(c)).cast("bigint").alias(f"_m{i}") for i, c in enumerate(columns)])
        rows = F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("max_value"))
            for i, c in enumerate(columns)])
        return totals.select(F.inline(rows))

    return union_all([one(name, df, columns) for name, (df, columns) in tables.items()])


def high_water_marks(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], marks: DataFrame | None = None,
) -> DataFrame:
    """Marks advanced to each column's maximum; a mark never moves back and an empty table leaves it alone."""
    reached = column_maxima(tables).select("table_name", "column_name", F.col("max_value").alias("last_value"))
    parts = [reached] if marks is None else [
        reached, marks.select("table_name", "column_name", F.col("last_value").cast("bigint"))]
    return union_all(parts).groupBy("table_name", "column_name").agg(F.max("last_value").alias("last_value"))


def mark_messages(tables: Mapping[str, tuple[DataFrame, Sequence[tuple[str, str]]]]) -> DataFrame:
    """table_name, column_name, message for each (column, sequence) that is advanced; columns without a value leave theirs alone."""
    reached = column_maxima({name: (df, [c for c, _ in columns]) for name, (df, columns) in tables.items()})
    names = [(name, c, s) for name, (_, columns) in tables.items() for c, s in columns]
    sequences = local_rows(reached.sparkSession, names, strings("table_name", "column_name", "sequence_name"))
    return reached.filter("max_value is not null").join(sequences, ["table_name", "column_name"]).select(
        "table_name", "column_name", F.format_string(fixed.MARK_MESSAGE, "column_name", "sequence_name", "max_value").alias("message"))
