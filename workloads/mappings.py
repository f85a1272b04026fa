"""Mapping and projection queries."""

from pyspark.sql import functions as F

from tidemark.operators import mapping, projection
from workloads.catalogs import SQL_SIDES, sql_list, sql_words
from workloads.derived import NATIVE_TYPES, columns_catalog, duck, table
from workloads.registry import query

SQL_LOSSY = """({a} <> {b} and (
    {a} = 'timestamptz' and {b} in ('timestamp', 'date') or {a} = 'timestamp' and {b} = 'date' or {a} = 'float64' and {b} = 'float32'
    or {a} = 'int64' and {b} in ('int32', 'int16') or {a} = 'int32' and {b} = 'int16'
    or {a} = 'decimal' and {b} in ('float64', 'float32') or {a} in ('json', 'array') and {b} = 'string'))"""
WORDS = ["string", "int16", "int32", "int64", "float32", "float64", "decimal", "boolean", "uuid", "json", "binary", "date", "time",
         "timestamp", "timestamptz", "interval", "array", "enum", "geometry", "unknown"]


def sql_lossy(a: str, b: str) -> str:
    return SQL_LOSSY.format(a=a, b=b)


SQL_MAPPINGS = f"""mappings as (
    select s.comparison_id, s.qn as source_table, s.name as source_column, dt.qn as dest_table, s.name as dest_column,
           s.native_type as source_type, coalesce(d.native_type, s.native_type) as default_dest_type,
           cast(null as varchar) as override_dest_type, coalesce({sql_lossy('s.norm', 'coalesce(d.norm, s.norm)')}, false) as is_lossy,
           false as skip, cast(null as varchar) as notes
    from source s join (select distinct comparison_id, match_name, qn from dest) dt
      on dt.comparison_id = s.comparison_id and dt.match_name = s.match_name
    left join dest d on d.comparison_id = s.comparison_id and d.match_name = s.match_name and d.name = s.name)"""


def seeded(spark, sf_dir):
    return mapping.seed_mappings(
        columns_catalog(spark, sf_dir), table(spark, sf_dir, "all_tables"), table(spark, sf_dir, "comparisons"))


@query("seed_mappings", duck("select * from mappings", *SQL_SIDES, SQL_MAPPINGS))
def seed_mappings(spark, sf_dir):
    return seeded(spark, sf_dir)


SQL_DEFAULTS = """when 'int16' then 'smallint' when 'int32' then 'integer' when 'int64' then 'bigint' when 'float32' then 'real'
    when 'float64' then 'double precision' when 'decimal' then 'numeric' when 'boolean' then 'boolean' when 'uuid' then 'uuid'
    when 'json' then 'jsonb' when 'binary' then 'bytea' when 'date' then 'date' when 'time' then 'time' when 'timestamp' then 'timestamp'
    when 'timestamptz' then 'timestamptz' when 'interval' then 'interval' when 'array' then 'text[]' when 'geometry' then 'geometry'"""


@query("default_dest_types", duck(
    f"""select p_partkey, engine, native_type, case when engine = 'postgres' then native_type
          else case {sql_words('native_type')} {SQL_DEFAULTS} else 'text' end end as dest_type
        from (select p_partkey, case p_partkey % 3 when 0 then 'postgres' else 'spark' end as engine,
                {sql_list(NATIVE_TYPES)}[type_no + 1] as native_type from {{part_types}}) t"""))
def default_dest_types(spark, sf_dir):
    from tidemark.functions.types import normalize_type

    native = F.element_at(F.array(*[F.lit(n) for n in NATIVE_TYPES]), (F.col("type_no") + 1).cast("int"))
    rows = table(spark, sf_dir, "part_types").select(
        "p_partkey", F.expr("case p_partkey % 3 when 0 then 'postgres' else 'spark' end").alias("engine"),
        native.alias("native_type"))
    return rows.withColumn("dest_type", mapping.default_dest_type(
        F.col("engine"), F.col("native_type"), normalize_type(F.col("native_type")), F.lit("postgres")))


@query("lossy_pairs", duck(
    f"""select p_partkey, a, b, {sql_lossy('a', 'b')} as is_lossy from (
          select p_partkey, {sql_list(WORDS)}[1 + p_partkey % 20] as a,
                 {sql_list(WORDS)}[1 + floor(p_partkey / 20)::bigint % 20] as b from {{part}}) t"""))
def lossy_pairs(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in WORDS])
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(words, F.expr("cast(1 + p_partkey % 20 as int)")).alias("a"),
        F.element_at(words, F.expr("cast(1 + floor(p_partkey / 20) % 20 as int)")).alias("b"))
    return rows.withColumn("is_lossy", mapping.is_lossy(F.col("a"), F.col("b")))


OVERRIDES = """
    select comparison_id, source_table, source_column,
           case when source_column = 'c1' then source_table || '_new' end as dest_table,
           case when source_column = 'c2' then 'renamed' when source_column = 'c5' then 'c7' end as dest_column,
           case when source_column in ('c3', 'c5', 'c2') then 'date' when source_column = 'c4' then '' end as override_dest_type,
           case when source_column = 'c6' then true end as skip,
           case when source_column = 'c7' then 'checked' end as notes
    from {mappings} where source_table like '%4' or source_table like '%5'"""


@query("apply_overrides", duck(
    f"""select m.comparison_id, m.source_table, m.source_column, coalesce(o.dest_table, m.dest_table) as dest_table,
          coalesce(o.dest_column, m.dest_column) as dest_column, m.source_type, m.default_dest_type,
          case when o.override_dest_type is null then m.override_dest_type else nullif(o.override_dest_type, '') end
            as override_dest_type,
          case when o.override_dest_type is null then m.is_lossy else coalesce({sql_lossy('s.norm', 'd.norm')}, false) end as is_lossy,
          coalesce(o.skip, m.skip) as skip, coalesce(o.notes, m.notes) as notes
        from mappings m left join overrides o on o.comparison_id = m.comparison_id and o.source_table = m.source_table
          and o.source_column = m.source_column
        left join source s on s.comparison_id = m.comparison_id and s.qn = m.source_table and s.name = m.source_column
        left join (select c.comparison_id, t.qn, t.name, {sql_words('t.native_type')} as norm
                   from {{comparisons}} c join {{all_columns}} t on t.snapshot_id = c.dest_snapshot_id) d
          on d.comparison_id = m.comparison_id and d.qn = coalesce(o.dest_table, m.dest_table)
          and d.name = coalesce(o.dest_column, m.dest_column)""",
    *SQL_SIDES, SQL_MAPPINGS, f"overrides as ({OVERRIDES.replace('{mappings}', 'mappings')})"))
def apply_overrides(spark, sf_dir):
    mappings = seeded(spark, sf_dir)
    overrides = spark.sql(OVERRIDES, mappings=mappings)
    return mapping.apply_overrides(
        mappings, overrides, columns_catalog(spark, sf_dir), table(spark, sf_dir, "comparisons"))


@query("mapping_summary", duck(
    """select comparison_id, source_table, count(*) as column_count, count(*) filter (is_lossy) as lossy_count,
         count(*) filter (skip) as skip_count from mappings group by comparison_id, source_table""", *SQL_SIDES, SQL_MAPPINGS))
def mapping_summary(spark, sf_dir):
    return mapping.mapping_summary(seeded(spark, sf_dir))


def m(column, source_type, dest=None, cast=None, skip=False):
    return {"source_column": column, "dest_column": dest or column, "source_type": source_type,
            "default_dest_type": source_type, "override_dest_type": cast, "skip": skip}


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double precision",
               "o_orderdate": "timestamp", "o_orderpriority": "text"}


@query("project_cast", """
    select l_orderkey, cast(l_quantity * l_discount as integer) as half_rounded, cast(l_extendedprice as bigint) as l_extendedprice,
           cast(l_shipdate as date)::varchar as l_shipdate, substr(l_linestatus || l_returnflag, 1, 1) as short_text,
           cast(cast(l_extendedprice as decimal(12,2)) as decimal(12,1))::double as one_digit from lineitem""")
def project_cast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("half", F.expr("l_quantity * l_discount")).withColumn(
        "both", F.expr("l_linestatus || l_returnflag")).withColumn("money", F.col("l_extendedprice").cast("decimal(12,2)"))
    done = projection.project(rows, [
        m("l_orderkey", "bigint"), m("half", "double precision", "half_rounded", "integer"),
        m("l_extendedprice", "double precision", cast="bigint"), m("l_shipdate", "timestamp", cast="date"),
        m("both", "text", "short_text", "varchar(1)"), m("money", "numeric(12,2)", "one_digit", "numeric(12,1)")])
    return done.withColumn("l_shipdate", F.col("l_shipdate").cast("string")).withColumn(
        "one_digit", F.col("one_digit").cast("double"))


LONG_PREFIX = "123456789012345678901234567890"


@query("project_casts_interval", f"""
    select l_orderkey, l_linenumber, l_linenumber * 12 + m as months, -d as days, (h * 60 + n) * 60000000 as microseconds,
           concat_ws(' ', l_linenumber || ' year' || case when l_linenumber <> 1 then 's' else '' end,
             case when m <> 0 then m || ' mon' || case when m <> 1 then 's' else '' end end, case when d <> 0 then '-' || d || ' days' end,
             case when h + n <> 0 then case when d <> 0 then '+' else '' end || lpad(h::varchar, 2, '0') || ':' || lpad(n::varchar, 2, '0')
               || ':00' end) as written,
           '{LONG_PREFIX}' || lpad(cast(cast(l_extendedprice as decimal(12,2)) as decimal(12,1))::varchar, 12, '0') as wide
    from (select *, l_partkey % 12 as m, l_suppkey % 40 as d, l_partkey % 30 as h, l_orderkey % 60 as n from lineitem) l""")
def project_casts_interval(spark, sf_dir):
    """Interval texts to months, days and microseconds and back to text, and numbers of more than 38 digits."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "concat(l_linenumber, ' years ', l_partkey % 12, ' mons -', l_suppkey % 40, ' days +', l_partkey % 30, ':', lpad(l_orderkey % 60, 2, '0')) as span",
        f"concat('{LONG_PREFIX}', lpad(cast(cast(l_extendedprice as decimal(12,2)) as string), 13, '0')) as wide")
    done = projection.project(rows, [
        m("l_orderkey", "bigint"), m("l_linenumber", "integer"), m("span", "text", cast="interval"), m("wide", "text", cast="numeric(45,1)")])
    again = projection.project(done, [
        m("l_orderkey", "bigint"), m("l_linenumber", "integer"), m("span", "interval"), m("span", "interval", "written", "text"),
        m("wide", "numeric(45,1)")])
    return again.select("l_orderkey", "l_linenumber", *[F.col(f"span.{c}").cast("bigint").alias(c) for c in ("months", "days", "microseconds")],
                        "written", "wide")


@query("project_rename", "select o_custkey as customer_id, o_orderkey as id, o_totalprice as total from orders")
def project_rename(spark, sf_dir):
    return projection.project(table(spark, sf_dir, "orders"), [
        m("o_orderkey", "bigint", "id"), m("o_custkey", "bigint", "customer_id"),
        m("o_totalprice", "double precision", "total")])


@query("project_skip", "select o_orderkey, o_totalprice, o_orderdate::varchar as o_orderdate from orders")
def project_skip(spark, sf_dir):
    kept = {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"}
    rows = [m(c, t, skip=c not in kept) for c, t in ORDER_TYPES.items()]
    rows[2]["dest_column"] = ""
    done = projection.project(table(spark, sf_dir, "orders"), rows, generated=["o_orderpriority"], dest_table="public.orders")
    return done.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


ORDER_MAPPINGS = [
    m("o_orderkey", "bigint", "id"), m("o_custkey", "bigint", "customer_id", "integer"),
    m("o_orderstatus", "text", cast="varchar(1)"), m("o_totalprice", "double precision", "total", "numeric(12,2)"),
    m("o_orderdate", "timestamp", "ordered_on", "date"), m("o_orderpriority", "text", "priority", "varchar(4)"),
]


@query("project_all", """
    select o_custkey::integer as customer_id, o_orderkey as id, substr(o_orderstatus, 1, 1) as o_orderstatus,
           o_totalprice::decimal(12,2)::varchar as total, o_orderdate::date::varchar as ordered_on,
           substr(o_orderpriority, 1, 4) as priority from orders""")
def project_all(spark, sf_dir):
    done = projection.project(table(spark, sf_dir, "orders"), ORDER_MAPPINGS)
    return done.withColumn("total", F.col("total").cast("string")).withColumn(
        "ordered_on", F.col("ordered_on").cast("string"))


@query("lossy_audit", """
    select column_name, dest_type, rejected_rows, changed_rows from (
      select unnest(['l_extendedprice', 'l_orderkey', 'l_quantity', 'l_returnflag', 'l_shipdate']) as column_name,
             unnest(['integer', 'smallint', 'integer', 'varchar(1)', 'date']) as dest_type,
             unnest([0, count(*) filter (l_orderkey > 32767), 0, 0, 0]) as rejected_rows,
             unnest([count(*) filter (cast(l_extendedprice as integer)::double <> l_extendedprice), 0,
                     count(*) filter (cast(l_quantity as integer)::double <> l_quantity),
                     count(*) filter (substr(l_returnflag, 1, 1) <> l_returnflag),
                     count(*) filter (l_shipdate::date::timestamp <> l_shipdate)]) as changed_rows from lineitem) t""")
def lossy_audit(spark, sf_dir):
    return projection.lossy_audit(table(spark, sf_dir, "lineitem"), [
        m("l_extendedprice", "double precision", cast="integer"), m("l_orderkey", "bigint", cast="smallint"),
        m("l_quantity", "double precision", cast="integer"), m("l_returnflag", "text", cast="varchar(1)"),
        m("l_shipdate", "timestamp", cast="date"), m("l_partkey", "bigint")])


@query("lossy_audit_events", """
    select column_name, dest_type, rejected_rows, changed_rows from (
      select unnest(['event_type', 'ts', 'user_id', 'value']) as column_name,
             unnest(['varchar(5)', 'date', 'smallint', 'bigint']) as dest_type, unnest([0, 0, 0, 0]) as rejected_rows,
             unnest([count(*) filter (substr(event_type, 1, 5) <> event_type),
                     count(*) filter (ts::date::timestamp <> ts), 0,
                     count(*) filter (cast(value as bigint)::double <> value)]) as changed_rows from events) t""")
def lossy_audit_events(spark, sf_dir):
    return projection.lossy_audit(table(spark, sf_dir, "events"), [
        m("value", "double precision", cast="bigint"), m("user_id", "bigint", cast="smallint"),
        m("event_type", "text", cast="varchar(5)"), m("ts", "timestamp", cast="date")])


LOOKUP = "select c_custkey as old_id, c_custkey + 1000000 as new_id from {customer} where c_custkey % 4 <> 1"


@query("fk_remap", duck(
    "select o_orderkey, coalesce(new_id, o_custkey) as o_custkey, o_totalprice from {orders} "
    "left join lookup on old_id = o_custkey", f"lookup as ({LOOKUP})"))
def fk_remap(spark, sf_dir):
    lookup = spark.sql(LOOKUP, customer=table(spark, sf_dir, "customer"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return projection.fk_remap(rows, "o_custkey", lookup, "old_id", "new_id")
