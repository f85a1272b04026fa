"""Schema drift between snapshots.

``comparisons`` has comparison_id, source_snapshot_id, dest_snapshot_id, source_schema and dest_schema;
all comparisons are diffed in one job. With both schemas set, only their tables take part and are
matched on the bare name; with neither, every table is matched on its qualified name.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import qualified
from tidemark.operators.keyed import frequent_keys, lookup_join, union_all
from tidemark.sources.storage import use_checkpoints

DRIFT = ["comparison_id", "table_label", "column_name", "kind", "source_value", "dest_value", "phase", "kind_rank"]


def check_scope(source_schema: str | None, dest_schema: str | None) -> None:
    if bool(source_schema) != bool(dest_schema):
        raise ValueError("Provide both source_schema and dest_schema, or neither")


def _scope(comparisons: DataFrame) -> DataFrame:
    """Empty schema names count as none; a one-sided scope is an error."""
    source, dest = F.nullif(F.col("source_schema"), F.lit("")), F.nullif(F.col("dest_schema"), F.lit(""))
    one_sided = source.isNull() != dest.isNull()
    checked = F.when(one_sided, F.raise_error(F.lit("Provide both source_schema and dest_schema, or neither")).cast("string"))
    return comparisons.select(
        "comparison_id", "source_snapshot_id", "dest_snapshot_id",
        checked.otherwise(source).alias("source_schema"), checked.otherwise(dest).alias("dest_schema"))


def in_scope(catalog: DataFrame, comparisons: DataFrame, side: str) -> DataFrame:
    """Catalog rows of one side of every comparison, with the name they are matched on."""
    scope = _scope(comparisons).select(
        "comparison_id", F.col(f"{side}_snapshot_id").alias("snapshot_id"), F.col(f"{side}_schema").alias("_schema"),
        "source_schema", "dest_schema")
    return _matched(lookup_join(catalog, scope, ["snapshot_id"], "inner")).drop("snapshot_id")


def _matched(rows: DataFrame) -> DataFrame:
    scoped = F.col("_schema").isNotNull()
    return rows.filter(~scoped | (F.col("schema_name") == F.col("_schema"))).withColumn(
        "match_name", F.when(scoped, F.col("table_name")).otherwise(F.col("qn"))).drop("_schema")


def table_presence(tables: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Every table of every comparison with a flag per side, from one aggregation."""
    return _presence({name: in_scope(tables, comparisons, name) for name in ("source", "dest")})


def _presence(sides: dict[str, DataFrame]) -> DataFrame:
    def side(name: str) -> DataFrame:
        return sides[name].select(
            "comparison_id", "match_name", "source_schema", "dest_schema",
            F.lit(name == "source").alias("in_source"), F.lit(name == "dest").alias("in_dest"))

    return side("source").unionByName(side("dest")).groupBy(
        "comparison_id", "match_name", "source_schema", "dest_schema").agg(
        F.bool_or("in_source").alias("in_source"), F.bool_or("in_dest").alias("in_dest"))


def _prefixed(schema: str) -> Column:
    return F.when(F.col(schema).isNull(), F.col("match_name")).otherwise(qualified(F.col(schema), F.col("match_name")))


def tables_only_in_source(presence: DataFrame) -> DataFrame:
    return presence.filter("in_source and not in_dest").select(
        "comparison_id", _prefixed("source_schema").alias("table_label"))


def tables_only_in_dest(presence: DataFrame) -> DataFrame:
    return presence.filter("in_dest and not in_source").select(
        "comparison_id", _prefixed("dest_schema").alias("table_label"))


def common_tables(presence: DataFrame) -> DataFrame:
    """Tables on both sides; a pair from two differently named schemas shows both."""
    pair = F.concat(_prefixed("source_schema"), F.lit(" → "), _prefixed("dest_schema"))
    return presence.filter("in_source and in_dest").select(
        "comparison_id", "match_name",
        F.when(F.col("source_schema") != F.col("dest_schema"), pair).otherwise(_prefixed("source_schema"))
        .alias("table_label"))


def _truth(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def _fk_json(fk: Column) -> Column:
    """JSON with the keys schema_, table, column."""
    return F.to_json(fk, {"ignoreNullFields": "false"})


def schema_drift(columns: DataFrame, tables: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per difference between the columns of tables on both sides.

    Sorted by table_label, phase, column_name, kind_rank the rows are in report order: columns missing
    in the destination, columns missing in the source, then changes per shared column.
    """
    sides = ("source", "dest")
    return _drift(
        {name: in_scope(columns, comparisons, name) for name in sides}, table_presence(tables, comparisons))


def _drift(sides: dict[str, DataFrame], presence: DataFrame) -> DataFrame:
    # rows carry the source side's name also in a cross-schema pair
    common = presence.filter("in_source and in_dest").select(
        "comparison_id", "match_name", _prefixed("source_schema").alias("table_label"))

    def side(name: str) -> DataFrame:
        # the scan stays narrow: only the compared attributes travel through the join
        attributes = F.struct("native_type", "normalized_type", "nullable", "default_expr", "is_pk", "fk")
        return sides[name].select(
            "comparison_id", "match_name", F.col("name").alias("column_name"), attributes.alias(name))

    joined = side("source").join(side("dest"), ["comparison_id", "match_name", "column_name"], "full")
    # very wide tables are looked for in the catalog scan, not in the join above
    table_key = ["comparison_id", "match_name"]
    wide = frequent_keys(
        sides["source"].select(*table_key).unionByName(sides["dest"].select(*table_key)), table_key)
    shared = lookup_join(joined, common, table_key, "inner", frequent=wide)
    s, d = F.col("source"), F.col("dest")
    none = F.lit(None).cast("string")
    both = s.isNotNull() & d.isNotNull()

    def entry(kind: str, condition: Column, source: Column = none, dest: Column = none, phase: int = 2) -> Column:
        return F.when(condition, F.struct(
            F.lit(kind).alias("kind"), source.alias("source_value"), dest.alias("dest_value"),
            F.lit(phase).alias("phase"), F.lit(fixed.DRIFT_KINDS.index(kind)).alias("kind_rank")))

    def type_text(c: Column) -> Column:
        return F.format_string("%s (%s)", c["native_type"], c["normalized_type"])

    def changed(name: str) -> Column:
        return both & ~s[name].eqNullSafe(d[name])

    entries = F.array(
        entry("missing_in_dest", d.isNull(), phase=0),
        entry("missing_in_source", s.isNull(), phase=1),
        entry("type_changed", changed("native_type") | changed("normalized_type"), type_text(s), type_text(d)),
        entry("nullable_changed", changed("nullable"), _truth(s["nullable"]), _truth(d["nullable"])),
        entry("default_changed", changed("default_expr"), s["default_expr"], d["default_expr"]),
        entry("pk_changed", changed("is_pk"), _truth(s["is_pk"]), _truth(d["is_pk"])),
        entry("fk_changed", changed("fk"), _fk_json(s["fk"]), _fk_json(d["fk"])))
    found = shared.select(
        "comparison_id", "table_label", "column_name", F.explode(F.array_compact(entries)).alias("entry"))
    return found.select("comparison_id", "table_label", "column_name", "entry.*").select(*DRIFT)


def compare(
    source_columns: DataFrame, dest_columns: DataFrame,
    source_schema: str | None = None, dest_schema: str | None = None,
) -> DataFrame:
    """Drift of a single pair of column catalogs."""
    check_scope(source_schema, dest_schema)

    def side(catalog: DataFrame, schema: str | None) -> DataFrame:
        return _matched(catalog.select(
            *[c for c in catalog.columns if c != "snapshot_id"], F.lit("pair").alias("comparison_id"),
            F.lit(schema or None).cast("string").alias("_schema"),
            F.lit(source_schema or None).cast("string").alias("source_schema"),
            F.lit(dest_schema or None).cast("string").alias("dest_schema")))

    sides = {"source": side(source_columns, source_schema), "dest": side(dest_columns, dest_schema)}
    return _drift(sides, _presence(sides))


def drift_summary(presence: DataFrame, drift: DataFrame) -> DataFrame:
    """Per comparison: table counts, tables with drift and drift rows."""
    flags = presence.select(
        "comparison_id", (F.col("in_source") & F.col("in_dest")).cast("int").alias("common_tables"),
        (F.col("in_source") & ~F.col("in_dest")).cast("int").alias("only_in_source"),
        (F.col("in_dest") & ~F.col("in_source")).cast("int").alias("only_in_dest"),
        F.lit(0).alias("tables_with_drift"), F.lit(0).cast("bigint").alias("drift_rows"))
    per_table = drift.groupBy("comparison_id", "table_label").agg(F.count("*").alias("drift_rows")).select(
        "comparison_id", *[F.lit(0).alias(c) for c in ("common_tables", "only_in_source", "only_in_dest")],
        F.lit(1).alias("tables_with_drift"), "drift_rows")
    return flags.unionByName(per_table).groupBy("comparison_id").agg(*[
        F.sum(c).alias(c)
        for c in ("common_tables", "only_in_source", "only_in_dest", "tables_with_drift", "drift_rows")])


def comparison_report(
    comparisons: DataFrame, columns: DataFrame, tables: DataFrame, snapshots: DataFrame, notes: DataFrame,
) -> DataFrame:
    """One flat report per comparison: scope, both sides, summary, lists, drift and lint notes with guidance.

    ``snapshots`` has snapshot_id, label, table_count, view_count, policy_count; ``notes`` is a lint report
    with guidance per snapshot. Order by comparison_id, section_rank, item, rank, detail for reading.
    """
    use_checkpoints(comparisons.sparkSession)
    # both feed several sections, so they are computed once and written to the shared folder
    presence = table_presence(tables, comparisons).checkpoint()
    drift = schema_drift(columns, tables, comparisons).checkpoint()
    scope = _scope(comparisons)

    def section(df: DataFrame, rank: int, name: str, item: Column, detail: Column, order: Column | None = None):
        return df.select(
            "comparison_id", F.lit(rank).alias("section_rank"), F.lit(name).alias("section"), item.alias("item"),
            (order if order is not None else F.lit(0)).cast("int").alias("rank"), detail.alias("detail"))

    scope_text = (
        F.when(F.col("source_schema").isNull(), "all non-system schemas (whole-DB diff)")
        .when(F.col("source_schema") == F.col("dest_schema"), F.format_string("schema %s on both sides", "source_schema"))
        .otherwise(F.format_string("schema %s (source) → %s (destination)", "source_schema", "dest_schema")))
    parts = [section(scope, 0, "scope", F.lit("scope"), scope_text)]
    for i, side in enumerate(("source", "dest")):
        of_side = scope.select("comparison_id", F.col(f"{side}_snapshot_id").alias("snapshot_id"))
        described = lookup_join(of_side, snapshots, ["snapshot_id"], "left")
        parts.append(section(described, 1, "databases", F.lit(side), F.format_string(
            "%s: %d tables, %d views, %d policies", "label", "table_count", "view_count", "policy_count"), F.lit(i)))
    summary = drift_summary(presence, drift)
    for i, c in enumerate(("common_tables", "only_in_source", "only_in_dest", "tables_with_drift", "drift_rows")):
        parts.append(section(summary, 2, "summary", F.lit(c), F.col(c).cast("string"), F.lit(i)))
    parts.append(section(tables_only_in_source(presence), 3, "only_in_source", F.col("table_label"), F.lit("")))
    parts.append(section(tables_only_in_dest(presence), 4, "only_in_dest", F.col("table_label"), F.lit("")))
    change = F.concat_ws(
        " | ", "column_name", F.replace("kind", F.lit("_"), F.lit(" ")),
        F.coalesce("source_value", F.lit("")), F.coalesce("dest_value", F.lit("")))
    parts.append(section(drift, 5, "drift", F.col("table_label"), change, F.col("kind_rank")))
    for i, side in enumerate(("source", "dest")):
        of_side = scope.select("comparison_id", F.col(f"{side}_snapshot_id").alias("snapshot_id"))
        # notes are the many side, comparisons the lookup
        noted = lookup_join(notes, of_side, ["snapshot_id"], "inner")
        text = F.concat_ws(" ", F.format_string("[%s]", F.upper("severity")), "target", "message", "guidance")
        parts.append(section(noted, 6 + i, f"notes_{side}", F.col("code"), text))
    return union_all(parts)
