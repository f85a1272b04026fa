"""Reading and writing tables of any Spark source."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.text import quoted


def scan(
    spark: SparkSession, location: str, columns: Sequence[str] | None = None, fmt: str = "parquet", **options,
) -> DataFrame:
    """One table with only the wanted columns; Spark prunes the scan to them.

    ``fmt`` is a Spark source: a file format with a path, ``table`` with a table name, or ``jdbc`` with a
    table name and the usual options. A JDBC read without partitionColumn, lowerBound, upperBound and
    numPartitions would run as one task, so those are required.
    """
    if fmt == "table":
        df = spark.read.options(**options).table(location)
    elif fmt == "jdbc":
        absent = [o for o in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if o not in options]
        if absent:
            raise ValueError(f"partitioned jdbc read needs {', '.join(absent)}")
        df = spark.read.format("jdbc").options(dbtable=location, **options).load()
    else:
        df = spark.read.format(fmt).options(**options).load(location)
    return df if columns is None else df.select(*[quoted(c) for c in columns])


def sink(df: DataFrame, location: str, mode: str = "append", fmt: str = "parquet", **options) -> None:
    """Write rows into the named columns of a destination, committed once by Spark's writer."""
    writer = df.write.mode(mode).options(**options)
    if fmt == "table":
        if df.sparkSession.catalog.tableExists(location):
            # by position: put the columns in the table's order
            order = df.sparkSession.table(location).columns
            df.select(*[quoted(c) for c in order]).write.options(**options).insertInto(
                location, overwrite=mode == "overwrite")
        else:
            writer.saveAsTable(location)
    elif fmt == "jdbc":
        writer.format("jdbc").options(dbtable=location, truncate=str(mode == "overwrite").lower()).save()
    else:
        writer.format(fmt).save(location)
