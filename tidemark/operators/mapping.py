"""Column mappings between two snapshots.

mappings: comparison_id, source_table, source_column, dest_table, dest_column, source_type,
default_dest_type, override_dest_type, is_lossy, skip, notes
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.types import normalize_type, text_map
from tidemark.operators.drift import in_scope
from tidemark.operators.keyed import frequent_keys, lookup_join

MAPPING = [
    "comparison_id", "source_table", "source_column", "dest_table", "dest_column", "source_type",
    "default_dest_type", "override_dest_type", "is_lossy", "skip", "notes",
]
MAPPING_KEY = ["comparison_id", "source_table", "source_column"]


def default_dest_type(
    source_engine: Column, native: Column, normalized: Column, dest_engine: Column,
) -> Column:
    """The source's own type between equal engines, else the registry's choice."""
    listed = F.when(dest_engine == "postgres", text_map(fixed.DEFAULT_DEST_TYPES)[normalized])
    return F.when(source_engine == dest_engine, native).otherwise(
        F.coalesce(listed, F.lit(fixed.FALLBACK_DEST_TYPE)))


def is_lossy(source: Column, dest: Column) -> Column:
    """Whether a conversion between two normalized types is on the lossy list."""
    listed = F.concat_ws(">", source, dest).isin([f"{s}>{d}" for s, d in fixed.LOSSY_PAIRS])
    return F.coalesce((source != dest) & listed, F.lit(False))


def effective_dest_type(override: Column, default: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(override, F.lit("")), default, F.lit("")))


def seed_mappings(
    columns: DataFrame, tables: DataFrame, comparisons: DataFrame,
    source_engine: str = "postgres", dest_engine: str = "postgres",
) -> DataFrame:
    """One row per source column whose table the destination has, mapped to the column of the same name.

    The row is kept when the destination lacks that column; its type then comes from the registry.
    """
    source = in_scope(columns, comparisons, "source").select(
        "comparison_id", "match_name", F.col("qn").alias("source_table"), F.col("name").alias("source_column"),
        F.col("native_type").alias("source_type"), F.col("normalized_type").alias("_source_norm"))
    dest_tables = in_scope(tables, comparisons, "dest").select(
        "comparison_id", "match_name", F.col("qn").alias("dest_table"))
    dest = in_scope(columns, comparisons, "dest").select(
        "comparison_id", "match_name", F.col("name").alias("source_column"),
        F.col("native_type").alias("_dest_native"), F.col("normalized_type").alias("_dest_norm"))
    matched = lookup_join(source, dest_tables, ["comparison_id", "match_name"], "inner")
    rows = matched.join(dest, ["comparison_id", "match_name", "source_column"], "left")
    chosen = default_dest_type(
        F.lit(source_engine), F.col("source_type"), F.col("_source_norm"), F.lit(dest_engine))
    none = F.lit(None).cast("string")
    return rows.select(
        "comparison_id", "source_table", "source_column", "dest_table",
        F.col("source_column").alias("dest_column"), "source_type",
        F.coalesce("_dest_native", chosen).alias("default_dest_type"), none.alias("override_dest_type"),
        is_lossy(F.col("_source_norm"), F.coalesce("_dest_norm", "_source_norm")).alias("is_lossy"),
        F.lit(False).alias("skip"), none.alias("notes"))


def apply_overrides(
    mappings: DataFrame, overrides: DataFrame, columns: DataFrame, comparisons: DataFrame,
    by_override_type: bool = False,
) -> DataFrame:
    """Mappings with the non-null fields of their override.

    An empty override type clears to null. Setting one recomputes is_lossy from the snapshots' types of
    the mapped columns or, with ``by_override_type``, from the override's own type.
    """
    given = overrides.select(
        *MAPPING_KEY, *[F.col(c).alias(f"_{c}") for c in ("dest_table", "dest_column", "override_dest_type", "skip", "notes")])
    rows = mappings.join(given, MAPPING_KEY, "left")
    rows = rows.select(
        *MAPPING_KEY, F.coalesce("_dest_table", "dest_table").alias("dest_table"),
        F.coalesce("_dest_column", "dest_column").alias("dest_column"), "source_type", "default_dest_type",
        F.when(F.col("_override_dest_type").isNull(), F.col("override_dest_type"))
        .otherwise(F.nullif(F.col("_override_dest_type"), F.lit(""))).alias("override_dest_type"),
        "is_lossy", F.coalesce("_skip", "skip").alias("skip"), F.coalesce("_notes", "notes").alias("notes"),
        F.col("_override_dest_type").isNotNull().alias("_changed"))

    def types(side: str, table: str, column: str) -> DataFrame:
        snapshots = comparisons.select("comparison_id", F.col(f"{side}_snapshot_id").alias("snapshot_id"))
        return lookup_join(
            columns.select("snapshot_id", F.col("qn").alias(table), F.col("name").alias(column),
                           F.col("normalized_type").alias(f"_{side}_norm")),
            snapshots, ["snapshot_id"], "inner").drop("snapshot_id")

    # several mappings may point at one destination column, so that side is a lookup
    dest_key = ["comparison_id", "dest_table", "dest_column"]
    frequent = frequent_keys(rows, dest_key)
    rows = rows.join(types("source", "source_table", "source_column"), MAPPING_KEY, "left")
    rows = lookup_join(rows, types("dest", "dest_table", "dest_column"), dest_key, frequent=frequent)
    target = F.col("_dest_norm")
    if by_override_type:
        target = F.coalesce(normalize_type(F.col("override_dest_type")), target)
    lossy = F.when(F.col("_changed"), is_lossy(F.col("_source_norm"), target)).otherwise(F.col("is_lossy"))
    return rows.withColumn("is_lossy", lossy).select(*MAPPING)


def mapping_summary(mappings: DataFrame) -> DataFrame:
    """Per comparison and source table: mapped columns, lossy ones and skipped ones."""
    return mappings.groupBy("comparison_id", "source_table").agg(
        F.count("*").alias("column_count"), F.count_if("is_lossy").alias("lossy_count"),
        F.count_if("skip").alias("skip_count")).orderBy("comparison_id", "source_table")


def ordered_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.orderBy("comparison_id", "source_table", "source_column")
