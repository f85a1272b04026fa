"""Catalogs: what tables, columns, keys and views a set of sources has.

Catalog tables carry a snapshot_id, so one job handles all snapshots of an estate. Columns:

* cat_tables:  snapshot_id, schema_name, table_name, qn, row_count_estimate, rls_enabled
* cat_columns: snapshot_id, schema_name, table_name, qn, pos, name, native_type, normalized_type, nullable,
  default_expr, is_pk, fk struct<schema_, table, column>, is_generated
* cat_views:   snapshot_id, schema_name, view_name, definition
"""

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import name_of, qualified, quoted, schema_of
from tidemark.functions.types import native_of, normalize_type
from tidemark.operators.keyed import local_rows, lookup_join, union_all

FK_TYPE = "struct<schema_:string,table:string,column:string>"


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows per table without reading any column, all tables in one aggregation.

    A seed row per table keeps empty tables in the result.
    """
    spark = next(iter(tables.values())).sparkSession
    seeds = local_rows(spark, [(qn, 0) for qn in tables], pa.schema([("qn", pa.string()), ("one", pa.int64())]))
    rows = [df.select(F.lit(qn).alias("qn"), F.lit(1).cast("bigint").alias("one")) for qn, df in tables.items()]
    return union_all([seeds, *rows]).groupBy("qn").agg(F.sum("one").alias("row_count"))


def observed_nulls(tables: Mapping[str, DataFrame]) -> DataFrame:
    """qn, name, null_rows: one pass per table. Files declare no NOT NULL, so it is measured."""
    def one(qn: str, df: DataFrame) -> DataFrame:
        totals = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[
            F.struct(F.lit(qn).alias("qn"), F.lit(c).alias("name"), F.col(f"_c{i}").alias("null_rows"))
            for i, c in enumerate(df.columns)])
        return totals.select(F.inline(rows))

    return union_all([one(qn, df) for qn, df in tables.items()])


def catalog_columns(
    tables: Mapping[str, DataFrame], keys: DataFrame, snapshot_id: str = "live", observe: bool = False,
) -> DataFrame:
    """One row per column of the given tables in table order.

    Types come from the schemas. ``keys`` declares what files cannot: qn, name, is_pk, fk, default_expr,
    is_generated. Nothing of the tables is read unless ``observe`` is set: then a column is nullable when it holds a null.
    """
    spark = next(iter(tables.values())).sparkSession
    listed = local_rows(
        spark,
        [(qn, i, f.name, native_of(f.dataType), f.nullable)
         for qn, df in tables.items() for i, f in enumerate(df.schema.fields)],
        pa.schema([("qn", pa.string()), ("pos", pa.int64()), ("name", pa.string()),
                   ("native_type", pa.string()), ("declared_nullable", pa.bool_())]))
    if observe:
        listed = listed.join(observed_nulls(tables), ["qn", "name"], "left").withColumn(
            "declared_nullable", F.coalesce(F.col("null_rows") > 0, "declared_nullable"))
    return listed.join(keys, ["qn", "name"], "left").select(
        F.lit(snapshot_id).alias("snapshot_id"), schema_of(F.col("qn")).alias("schema_name"),
        name_of(F.col("qn")).alias("table_name"), "qn", "pos", "name", "native_type",
        normalize_type(F.col("native_type")).alias("normalized_type"),
        F.col("declared_nullable").alias("nullable"), "default_expr",
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"), "fk",
        F.coalesce("is_generated", F.lit(False)).alias("is_generated"))


def catalog_tables(
    listing: DataFrame, stats: DataFrame, flags: DataFrame | None = None, snapshot_id: str = "live",
) -> DataFrame:
    """Listed tables with their row estimate (null when unknown) and RLS flag (false when unknown)."""
    rows = listing.select("qn").distinct().join(
        stats.select("qn", F.col("row_count").alias("row_count_estimate")), ["qn"], "left")
    if flags is not None:
        rows = rows.join(flags.select("qn", "rls_enabled"), ["qn"], "left")
    else:
        rows = rows.withColumn("rls_enabled", F.lit(False))
    return rows.select(
        F.lit(snapshot_id).alias("snapshot_id"), schema_of(F.col("qn")).alias("schema_name"),
        name_of(F.col("qn")).alias("table_name"), "qn", "row_count_estimate",
        F.coalesce("rls_enabled", F.lit(False)).alias("rls_enabled"))


def catalog_of_spark(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of one Spark database, by qualified name."""
    return {
        f"{database}.{t.name}": spark.table(f"`{database}`.`{t.name}`")
        for t in spark.catalog.listTables(database) if not t.isTemporary}


def user_schemas(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("schema_name").isin(fixed.SYSTEM_SCHEMAS))


def tables_of(columns: DataFrame) -> DataFrame:
    """The distinct tables of a column catalog."""
    return columns.select("snapshot_id", "schema_name", "table_name", "qn").distinct()


def fk_edges(columns: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Distinct child → parent pairs; edges to itself and to tables outside the selection are left out."""
    edges = columns.filter("fk is not null").select(
        "snapshot_id", F.col("qn").alias("child"),
        qualified(F.coalesce(F.col("fk.schema_"), F.lit(fixed.DEFAULT_SCHEMA)), F.col("fk.table")).alias("parent"))
    edges = edges.filter("child <> parent").distinct()
    if selected is None:
        selected = columns.select("snapshot_id", "qn")
    chosen = selected.select("snapshot_id", "qn").distinct()
    for end in ("child", "parent"):
        edges = lookup_join(edges, chosen.withColumnRenamed("qn", end), ["snapshot_id", end], "inner")
    return edges


def single_pk(columns: DataFrame) -> DataFrame:
    """Per table the key column when the primary key has exactly one column, else null."""
    key = F.when(F.col("is_pk"), F.col("name"))
    return columns.groupBy("snapshot_id", "qn").agg(F.count(key).alias("_n"), F.min(key).alias("_k")).select(
        "snapshot_id", "qn", F.when(F.col("_n") == 1, F.col("_k")).alias("pk_column"))


def generated_columns(source_columns: DataFrame, dest_columns: DataFrame) -> DataFrame:
    """Columns no load may write: generated on either side."""
    return union_all([
        c.filter("is_generated").select("qn", "name") for c in (source_columns, dest_columns)]).distinct()


def schema_summary(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Tables and views per schema; a schema with only views appears too."""
    def counted(df: DataFrame, is_table: int) -> DataFrame:
        return df.select("snapshot_id", "schema_name", F.lit(is_table).alias("t"), F.lit(1 - is_table).alias("v"))

    return counted(tables, 1).unionByName(counted(views, 0)).groupBy("snapshot_id", "schema_name").agg(
        F.sum("t").alias("table_count"), F.sum("v").alias("view_count")).orderBy("snapshot_id", "schema_name")


def snapshot_counts(snapshots: DataFrame, **parts: DataFrame) -> DataFrame:
    """Rows of each catalog part per snapshot, e.g. ``tables=cat_tables, columns=cat_columns``; missing parts count 0.

    Snapshots that carry an array ``warnings`` get its size as ``warnings_count``; null has none.
    """
    if "warnings" in snapshots.columns:
        parts = {**parts, "warnings": snapshots.select("snapshot_id", F.explode("warnings"))}
    tagged = [snapshots.select("snapshot_id", *[F.lit(0).alias(f"{p}_count") for p in parts])]
    tagged += [
        df.select("snapshot_id", *[F.lit(int(p == part)).alias(f"{p}_count") for p in parts])
        for part, df in parts.items()]
    return union_all(tagged).groupBy("snapshot_id").agg(*[F.sum(f"{p}_count").alias(f"{p}_count") for p in parts])


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per connection and how many there are, in one aggregation without a window."""
    return snapshots.groupBy("connection_id").agg(
        F.max(F.struct("captured_at", "snapshot_id")).alias("_latest"), F.count("*").alias("snapshot_count"),
    ).select("connection_id", F.col("_latest.snapshot_id").alias("snapshot_id"),
             F.col("_latest.captured_at").alias("captured_at"), "snapshot_count")
