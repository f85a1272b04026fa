"""Catalog and drift queries."""

from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.types import normalize_type
from tidemark.operators import drift
from tidemark.operators.keyed import local_rows, strings
from tidemark.sources import catalog
from tidemark.sources.tables import scan
from workloads.derived import FOREIGN_KEYS, GIVEN, KEYS, NATIVE_TYPES, columns_catalog, duck, given_tables, table
from workloads.parity import COLUMNS
from workloads.registry import query


def sql_words(native: str) -> str:
    """Normalized word of a native type expression, in words of its own."""
    base = f"regexp_replace(trim(lower({native})), '\\s*\\(.*\\)\\s*$', '')"
    return f"""case when {base} like '%[]' or starts_with({base}, '_') then 'array'
      when {base} in ('smallint', 'int2') then 'int16' when {base} in ('integer', 'int', 'int4') then 'int32'
      when {base} in ('bigint', 'int8') then 'int64' when {base} in ('real', 'float4') then 'float32'
      when {base} in ('double precision', 'float8') then 'float64' when {base} in ('numeric', 'decimal', 'money') then 'decimal'
      when {base} in ('varchar', 'character varying', 'char', 'character', 'text', 'citext', 'name') then 'string'
      when {base} in ('bool', 'boolean') then 'boolean' when {base} = 'uuid' then 'uuid' when {base} in ('json', 'jsonb') then 'json'
      when {base} = 'bytea' then 'binary' when {base} = 'date' then 'date' when {base} = 'interval' then 'interval'
      when {base} in ('time', 'timetz', 'time with time zone', 'time without time zone') then 'time'
      when {base} in ('timestamptz', 'timestamp with time zone') then 'timestamptz'
      when {base} in ('timestamp', 'timestamp without time zone') then 'timestamp' else 'unknown' end"""


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("scan_columns", "select l_orderkey, l_partkey, l_quantity from lineitem")
def scan_columns(spark, sf_dir):
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("normalize_types", duck(
    f"select p_partkey, native_type, {sql_words('native_type')} as normalized_type from "
    f"(select p_partkey, {sql_list(NATIVE_TYPES)}[type_no + 1] as native_type from {{part_types}}) t"))
def normalize_types(spark, sf_dir):
    native = F.element_at(F.array(*[F.lit(n) for n in NATIVE_TYPES]), (F.col("type_no") + 1).cast("int"))
    return table(spark, sf_dir, "part_types").select("p_partkey", native.alias("native_type")).withColumn(
        "normalized_type", normalize_type(F.col("native_type")))


def declared_keys(spark):
    """The keys the given files cannot declare."""
    parents = {(c, cc): (p, pc) for c, cc, p, pc in FOREIGN_KEYS}
    rows = [
        (f"public.{t}", c, c in KEYS[t], *(("public", *parents[t, c]) if (t, c) in parents else (None, None, None)))
        for t in GIVEN for c in COLUMNS[t]]
    keys = local_rows(spark, [(*r[:2], str(r[2]), *r[3:]) for r in rows],
                      strings("qn", "name", "is_pk", "fk_schema", "fk_table", "fk_column"))
    return keys.select(
        "qn", "name", (F.col("is_pk") == "True").alias("is_pk"),
        F.when(F.col("fk_table").isNotNull(), F.struct(
            F.col("fk_schema").alias("schema_"), F.col("fk_table").alias("table"), F.col("fk_column").alias("column")))
        .alias("fk"), F.lit(None).cast("string").alias("default_expr"), F.lit(False).alias("is_generated"))


def sql_catalog_columns() -> str:
    types = {"INTEGER": "integer", "BIGINT": "bigint", "DOUBLE": "double precision", "VARCHAR": "text",
             "TIMESTAMP": "timestamp without time zone", "FLOAT[]": "real[]"}
    cases = " ".join(f"when '{d}' then '{n}'" for d, n in types.items())
    parents = {(c, cc): f"public.{p}.{pc}" for c, cc, p, pc in FOREIGN_KEYS}
    rows = []
    for t in GIVEN:
        for i, c in enumerate(COLUMNS[t]):
            fk = f"'{parents[t, c]}'" if (t, c) in parents else "null"
            rows.append(
                f"select 'public.{t}' as qn, {i} as pos, '{c}' as name, any_value(typeof({c})) as duck_type, "
                f"count(*) > count({c}) as nullable, {str(c in KEYS[t]).lower()} as is_pk, {fk} as fk from {t}")
    return (f"select qn, pos, name, native_type, {sql_words('native_type')} as normalized_type, nullable, is_pk, fk from "
            f"(select *, case duck_type {cases} end as native_type from ({' union all '.join(rows)}) r) t")


@query("catalog_columns", sql_catalog_columns())
def catalog_columns(spark, sf_dir):
    found = catalog.catalog_columns(given_tables(spark, sf_dir), declared_keys(spark), observe=True)
    return found.select("qn", "pos", "name", "native_type", "normalized_type", "nullable", "is_pk",
                        F.concat_ws(".", "fk.schema_", "fk.table", "fk.column").alias("fk")).withColumn(
        "fk", F.nullif("fk", F.lit("")))


@query("catalog_tables", duck("""
    select 'src' as snapshot_id, c.qn, split_part(c.qn, '.', 1) as schema_name, split_part(c.qn, '.', 2) as table_name,
           d.row_count as row_count_estimate, coalesce(r.rls_enabled, false) as rls_enabled
    from (select distinct qn from {src_columns}) c left join {dest_counts} d on d.qn = c.qn
    left join (select qn, rls_enabled from {all_tables} where snapshot_id = 'src' and qn like '%3') r on r.qn = c.qn"""))
def catalog_tables(spark, sf_dir):
    listing = table(spark, sf_dir, "src_columns").select("qn").distinct()
    flags = table(spark, sf_dir, "all_tables").filter("snapshot_id = 'src' and qn like '%3'")
    return catalog.catalog_tables(listing, table(spark, sf_dir, "dest_counts"), flags, "src")


@query("table_stats", " union all ".join(f"select 'public.{t}' as qn, count(*) as row_count from {t}" for t in GIVEN))
def table_stats(spark, sf_dir):
    return catalog.table_stats(given_tables(spark, sf_dir))


SQL_SYSTEM = """(select *, case pos when 4 then 'pg_catalog' when 6 then 'information_schema' when 8 then 'pg_toast'
                 else schema_name end as found_schema from {src_columns}) s"""


@query("user_schemas", duck(
    "select found_schema as schema_name, qn, name from " + SQL_SYSTEM +
    " where found_schema not in ('pg_catalog', 'information_schema', 'pg_toast')"))
def user_schemas(spark, sf_dir):
    found = F.expr("case pos when 4 then 'pg_catalog' when 6 then 'information_schema' when 8 then 'pg_toast' "
                   "else schema_name end")
    return catalog.user_schemas(
        table(spark, sf_dir, "src_columns").withColumn("schema_name", found)).select("schema_name", "qn", "name")


@query("fk_edges", duck("""
    select distinct snapshot_id, child, parent from (
      select snapshot_id, qn as child, fk_schema || '.' || fk_table as parent from {all_columns} where fk_table is not null) e
    where child <> parent and exists (select 1 from {all_columns} c where c.snapshot_id = e.snapshot_id and c.qn = parent)"""))
def fk_edges(spark, sf_dir):
    return catalog.fk_edges(columns_catalog(spark, sf_dir))


@query("single_pk", duck("""
    select snapshot_id, qn, case when count(*) filter (is_pk) = 1 then min(name) filter (is_pk) end as pk_column
    from {all_columns} group by snapshot_id, qn"""))
def single_pk(spark, sf_dir):
    return catalog.single_pk(columns_catalog(spark, sf_dir))


@query("generated_columns", duck("select distinct qn, name from {all_columns} where is_generated"))
def generated_columns(spark, sf_dir):
    return catalog.generated_columns(
        columns_catalog(spark, sf_dir, "src_columns"), columns_catalog(spark, sf_dir, "dst_columns"))


@query("schema_summary", duck("""
    select snapshot_id, schema_name, count(*) filter (is_table) as table_count, count(*) filter (not is_table) as view_count
    from (select snapshot_id, schema_name, true as is_table from {all_tables}
          union all select snapshot_id, schema_name, false from {all_views}) t group by snapshot_id, schema_name"""))
def schema_summary(spark, sf_dir):
    return catalog.schema_summary(table(spark, sf_dir, "all_tables"), table(spark, sf_dir, "all_views"))


@query("snapshot_counts", duck("""
    select snapshot_id, (select count(*) from {all_tables} t where t.snapshot_id = s.snapshot_id) as tables_count,
           (select count(*) from {all_views} t where t.snapshot_id = s.snapshot_id) as views_count,
           (select count(*) from {all_columns} t where t.snapshot_id = s.snapshot_id) as columns_count,
           (select count(*) from {all_extensions} t where t.snapshot_id = s.snapshot_id) as extensions_count,
           (select count(*) from {all_policies} t where t.snapshot_id = s.snapshot_id) as policies_count
    from (select 'src' as snapshot_id union all select 'dst' union all select 'empty') s"""))
def snapshot_counts(spark, sf_dir):
    names = local_rows(spark, [("src",), ("dst",), ("empty",)], strings("snapshot_id"))
    return catalog.snapshot_counts(names, **{
        p: table(spark, sf_dir, f"all_{p}") for p in ("tables", "views", "columns", "extensions", "policies")})


SQL_WARNINGS = """
    select id as snapshot_id, case id % 7 when 0 then null when 1 then array('no tables readable') when 2 then array('', 'slow catalog')
      else array(connection_name, 'no views', 'no policies') end as warnings from {snapshots}"""


@query("snapshot_warnings", duck("""
    select id as snapshot_id, case id % 7 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as warnings_count,
           (select count(*) from {compared} c where c.id = s.id and c.source_schema is not null) as comparisons_count
    from {snapshots} s"""))
def snapshot_warnings(spark, sf_dir):
    """Warnings of every snapshot beside the scoped comparisons that have its number."""
    warned = spark.sql(SQL_WARNINGS, snapshots=table(spark, sf_dir, "snapshots"))
    scoped = table(spark, sf_dir, "compared").filter("source_schema is not null").withColumnRenamed("id", "snapshot_id")
    return catalog.snapshot_counts(warned, comparisons=scoped)


@query("latest_snapshot", duck("""
    select connection_id, id as snapshot_id, cast(captured_at as varchar) as captured_at, snapshot_count from (
      select *, row_number() over (partition by connection_id order by captured_at desc, id desc) as rn,
             count(*) over (partition by connection_id) as snapshot_count from {snapshots}) t where rn = 1"""))
def latest_snapshot(spark, sf_dir):
    found = catalog.latest_snapshot(table(spark, sf_dir, "snapshots").withColumnRenamed("id", "snapshot_id"))
    return found.withColumn("captured_at", F.col("captured_at").cast("string"))


# --- drift ------------------------------------------------------------------------------------------------

SQL_SIDES = [
    f"""{side} as (select c.comparison_id, c.source_schema, c.dest_schema, t.qn, t.schema_name, t.table_name, t.name,
          t.native_type, {sql_words('t.native_type')} as norm, t.nullable, t.default_expr, t.is_pk,
          case when t.fk_table is not null then '{{"schema_":"' || t.fk_schema || '","table":"' || t.fk_table ||
            '","column":"' || t.fk_column || '"}}' end as fk,
          case when c.{side}_schema is null then t.qn else t.table_name end as match_name
        from {{comparisons}} c join {{all_columns}} t on t.snapshot_id = c.{side}_snapshot_id
         and (c.{side}_schema is null or t.schema_name = c.{side}_schema))""".replace("{{", "{").replace("}}", "}")
    for side in ("source", "dest")]
SQL_PRESENCE = """presence as (
    select coalesce(s.comparison_id, d.comparison_id) as comparison_id, coalesce(s.match_name, d.match_name) as match_name,
           coalesce(s.source_schema, d.source_schema) as source_schema, coalesce(s.dest_schema, d.dest_schema) as dest_schema,
           s.match_name is not null as in_source, d.match_name is not null as in_dest
    from (select distinct comparison_id, match_name, source_schema, dest_schema from source) s
    full join (select distinct comparison_id, match_name, source_schema, dest_schema from dest) d
      on d.comparison_id = s.comparison_id and d.match_name = s.match_name)"""
SQL_LABEL = "case when {side}_schema is null then match_name else {side}_schema || '.' || match_name end"
SOURCE_LABEL, DEST_LABEL = SQL_LABEL.format(side="source"), SQL_LABEL.format(side="dest")
SQL_DRIFT = f"""drift as (
    select comparison_id, {SOURCE_LABEL} as table_label, column_name, e.kind as kind, e.s as source_value, e.d as dest_value,
           e.phase as phase, e.kind_rank as kind_rank
    from (
      select p.comparison_id, p.match_name, p.source_schema, coalesce(s.name, d.name) as column_name, unnest(list_filter([
        case when d.name is null then {{'kind': 'missing_in_dest', 's': null::varchar, 'd': null::varchar, 'phase': 0, 'kind_rank': 0}} end,
        case when s.name is null then {{'kind': 'missing_in_source', 's': null, 'd': null, 'phase': 1, 'kind_rank': 1}} end,
        case when s.native_type <> d.native_type or s.norm <> d.norm then {{'kind': 'type_changed',
          's': s.native_type || ' (' || s.norm || ')', 'd': d.native_type || ' (' || d.norm || ')', 'phase': 2, 'kind_rank': 2}} end,
        case when s.nullable <> d.nullable then {{'kind': 'nullable_changed', 's': case when s.nullable then 'True' else 'False' end,
          'd': case when d.nullable then 'True' else 'False' end, 'phase': 2, 'kind_rank': 3}} end,
        case when s.name = d.name and s.default_expr is distinct from d.default_expr then {{'kind': 'default_changed',
          's': s.default_expr, 'd': d.default_expr, 'phase': 2, 'kind_rank': 4}} end,
        case when s.is_pk <> d.is_pk then {{'kind': 'pk_changed', 's': case when s.is_pk then 'True' else 'False' end,
          'd': case when d.is_pk then 'True' else 'False' end, 'phase': 2, 'kind_rank': 5}} end,
        case when s.name = d.name and s.fk is distinct from d.fk then {{'kind': 'fk_changed', 's': s.fk, 'd': d.fk,
          'phase': 2, 'kind_rank': 6}} end], lambda x: x is not null)) as e
      from (select * from source) s
      full join (select * from dest) d
        on d.comparison_id = s.comparison_id and d.match_name = s.match_name and d.name = s.name
      join presence p on p.comparison_id = coalesce(s.comparison_id, d.comparison_id)
        and p.match_name = coalesce(s.match_name, d.match_name) and p.in_source and p.in_dest) t)"""
CTES = [*SQL_SIDES, SQL_PRESENCE, SQL_DRIFT]


def presence_of(spark, sf_dir):
    return drift.table_presence(table(spark, sf_dir, "all_tables"), table(spark, sf_dir, "comparisons"))


def drift_of(spark, sf_dir):
    return drift.schema_drift(
        columns_catalog(spark, sf_dir), table(spark, sf_dir, "all_tables"), table(spark, sf_dir, "comparisons"))


@query("tables_only_in_source", duck(
    f"select comparison_id, {SOURCE_LABEL} as table_label from presence where in_source and not in_dest",
    *SQL_SIDES, SQL_PRESENCE))
def tables_only_in_source(spark, sf_dir):
    return drift.tables_only_in_source(presence_of(spark, sf_dir))


@query("tables_only_in_dest", duck(
    f"select comparison_id, {DEST_LABEL} as table_label from presence where in_dest and not in_source",
    *SQL_SIDES, SQL_PRESENCE))
def tables_only_in_dest(spark, sf_dir):
    return drift.tables_only_in_dest(presence_of(spark, sf_dir))


@query("common_tables", duck(
    f"select comparison_id, match_name, case when source_schema <> dest_schema then {SOURCE_LABEL} || ' → ' || {DEST_LABEL} "
    f"else {SOURCE_LABEL} end as table_label from presence where in_source and in_dest", *SQL_SIDES, SQL_PRESENCE))
def common_tables(spark, sf_dir):
    return drift.common_tables(presence_of(spark, sf_dir))


@query("schema_drift", duck("select * from drift", *CTES))
def schema_drift(spark, sf_dir):
    return drift_of(spark, sf_dir)


def _register_kinds():
    for kind in fixed.DRIFT_KINDS:
        @query(f"drift_{kind}", duck(
            f"select table_label, column_name, source_value, dest_value from drift "
            f"where comparison_id = 'whole' and kind = '{kind}'", *CTES))
        def build(spark, sf_dir, kind=kind):
            pair = drift.compare(
                columns_catalog(spark, sf_dir, "src_columns").drop("snapshot_id"),
                columns_catalog(spark, sf_dir, "dst_columns").drop("snapshot_id"))
            return pair.filter(F.col("kind") == kind).select("table_label", "column_name", "source_value", "dest_value")


_register_kinds()


@query("schema_drift_scoped", duck(
    "select table_label, column_name, kind, source_value, dest_value from drift where comparison_id = 'cross'", *CTES))
def schema_drift_scoped(spark, sf_dir):
    return drift.compare(
        columns_catalog(spark, sf_dir, "src_columns").drop("snapshot_id"),
        columns_catalog(spark, sf_dir, "dst_columns").drop("snapshot_id"), "public", "archive",
    ).select("table_label", "column_name", "kind", "source_value", "dest_value")


SQL_SUMMARY = """summary as (
    select comparison_id, count(*) filter (in_source and in_dest) as common_tables,
           count(*) filter (in_source and not in_dest) as only_in_source,
           count(*) filter (in_dest and not in_source) as only_in_dest,
           (select count(distinct table_label) from drift d where d.comparison_id = p.comparison_id) as tables_with_drift,
           (select count(*) from drift d where d.comparison_id = p.comparison_id) as drift_rows
    from presence p group by comparison_id)"""


@query("drift_summary", duck("select * from summary", *CTES, SQL_SUMMARY))
def drift_summary(spark, sf_dir):
    return drift.drift_summary(presence_of(spark, sf_dir), drift_of(spark, sf_dir))


def snapshot_labels(spark, sf_dir):
    counts = catalog.snapshot_counts(
        local_rows(spark, [("src",), ("dst",)], strings("snapshot_id")),
        table=table(spark, sf_dir, "all_tables"), view=table(spark, sf_dir, "all_views"),
        policy=table(spark, sf_dir, "all_policies"))
    return counts.withColumn("label", F.concat(F.lit("db "), F.col("snapshot_id")))
