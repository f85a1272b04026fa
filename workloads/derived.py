"""Inputs of the registered queries: the given tables and tables derived from all of their rows.

Each derived table is one SQL text that reads the same in Spark and DuckDB; ``{name}`` is a given or
another derived table.
"""

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.types import normalize_type
from tidemark.sources.tables import scan

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations").split()

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}

FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]

# native types used by the type queries, by position
NATIVE_TYPES = [
    "text", "character varying(255)", "VARCHAR(20)", " char(3) ", "citext", "name", "smallint", "int2", "integer", "int4",
    "bigint", "INT8", "real", "float4", "double precision", "float8", "numeric(10,2)", "decimal", "money", "boolean",
    "bool", "uuid", "json", "jsonb", "bytea", "date", "time without time zone", "timetz", "timestamp",
    "timestamp without time zone", "timestamp with time zone", "timestamptz", "timestamp(3) without time zone",
    "interval", "text[]", "_int4", "numeric(10,2)[]", "my_enum", "geometry", "timestamp(3)",
]

DERIVED = {
    # destinations that differ from their source
    "orders_dst": """
        select o_orderkey, o_custkey, o_orderstatus,
               case when o_orderkey % 101 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
               o_orderdate, o_orderpriority
        from {orders} where o_orderkey % 97 <> 0
        union all
        select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        from {orders} where o_orderkey % 89 = 0""",
    "customer_dst": "select * from {customer} where c_custkey % 5 <> 0",
    "supplier_dst": "select * from {supplier} where 1 = 0",
    "customer_parent": "select * from {customer} where c_custkey % 50 <> 0",
    "orders_child": """
        select o_orderkey, case when o_orderkey % 13 = 0 then null else o_custkey end as o_custkey from {orders}""",
    "conversations_dst": """
        select conv_id, turn, role, case when conv_id % 7 = 0 and turn = 1 then text || '.' else text end as text
        from {conversations} where not (conv_id % 11 = 0 and turn = 0)""",
    # what to do about some of the lint codes, one row for each size of a part that stands for one
    "guidance": """
        select code, 'Size ' || cast(n as string) || ': ' || advice as guidance from (
          select p_size % 6 as k, min(p_size) as n from {part} group by p_size % 6) s
        join (
          select 0 as k, 'supabase.schemas_present' as code, 'pick the schemas that move' as advice
          union all select 1, 'supabase.gen_random_uuid_default', 'let the target make its own ids'
          union all select 2, 'supabase.fk_to_auth_users', 'move the user table first, or keep a plain column'
          union all select 3, 'supabase.rls_enabled', 'write the row rules anew'
          union all select 4, 'supabase.view_uses_auth_helper', 'replace the helper calls'
          union all select 5, 'some.other_code', 'nothing to do') a on a.k = s.k""",
    # catalogs: one table per ten parts, one column per part, in two snapshots
    "src_columns": """
        select 'src' as snapshot_id, schema_name, table_name, schema_name || '.' || table_name as qn, pos,
               'c' || cast(pos as string) as name, native_type, nullable, default_expr, is_pk,
               case when fk_kind = 1 then 'auth' when fk_kind = 2 then schema_name end as fk_schema,
               case when fk_kind = 1 then 'users' when fk_kind = 2 then 't' || cast(cast(floor(t / 3) as bigint) as string) end
                 as fk_table,
               case when fk_kind > 0 then 'id' end as fk_column, is_generated
        from (
          select cast(floor(p_partkey / 10) as bigint) as t,
                 't' || cast(cast(floor(p_partkey / 10) as bigint) as string) as table_name,
                 case cast(floor(p_partkey / 10) as bigint) % 11
                   when 3 then 'auth' when 7 then 'storage' else 'public' end as schema_name,
                 p_partkey % 10 as pos,
                 case p_size % 6 when 0 then 'bigint' when 1 then 'VARCHAR(255)' when 2 then 'timestamp with time zone'
                   when 3 then 'numeric(10,2)' when 4 then 'text[]' else 'jsonb' end as native_type,
                 p_partkey % 3 = 0 as nullable,
                 case when p_partkey % 7 = 0 then 'gen_random_uuid()' when p_partkey % 7 = 1 then '0' end as default_expr,
                 p_partkey % 10 = 0 or (p_partkey % 10 = 1 and p_size % 4 = 0) as is_pk,
                 case when p_partkey % 10 = 3 then 1 when p_partkey % 10 = 4 then 2 else 0 end as fk_kind,
                 p_partkey % 10 = 9 and p_size % 3 = 0 as is_generated
          from {part}) p""",
    "dst_columns": """
        select 'dst' as snapshot_id, schema_name, table_name, qn, pos, name,
               case when pos = 5 then 'text' else native_type end as native_type,
               case when pos = 6 then not nullable else nullable end as nullable,
               case when pos = 7 then null else default_expr end as default_expr,
               case when pos = 1 then false else is_pk end as is_pk,
               case when pos = 3 and qn like '%2' then null else fk_schema end as fk_schema,
               case when pos = 3 and qn like '%2' then null when pos = 4 and qn like '%5' then 'other' else fk_table end
                 as fk_table,
               case when pos = 3 and qn like '%2' then null else fk_column end as fk_column,
               pos = 8 as is_generated
        from {src_columns} where not (qn like '%9') and not (pos = 4 and qn like '%1')
        union all
        select 'dst', schema_name, table_name || 'x', qn || 'x', pos, name, native_type, nullable, default_expr, is_pk,
               fk_schema, fk_table, fk_column, is_generated
        from {src_columns} where qn like '%8'
        union all
        select 'dst', 'archive', table_name, 'archive.' || table_name, pos, name,
               case when pos = 2 then 'date' else native_type end, nullable, default_expr, is_pk,
               fk_schema, fk_table, fk_column, is_generated
        from {src_columns} where schema_name = 'public' and qn like '%4' and pos <> 6
        union all
        select 'dst', schema_name, table_name, qn, 10, 'extra', 'integer', true, null, false, null, null, null, false
        from {src_columns} where qn like '%6' and pos = 0""",
    "all_columns": "select * from {src_columns} union all select * from {dst_columns}",
    "all_tables": """
        select snapshot_id, schema_name, table_name, qn, cast(count(*) * 100 as bigint) as row_count_estimate,
               min(pos) = 0 and table_name like '%3' as rls_enabled
        from {all_columns} group by snapshot_id, schema_name, table_name, qn""",
    "all_views": """
        select snapshot_id, schema_name, 'v_' || table_name as view_name,
               'SELECT * FROM ' || qn || case when qn like '%2' then ' WHERE owner = auth.uid()'
                 when qn like '%4' then ' WHERE x = AUTH.ROLE ()' when qn like '%6' then ' WHERE myauth.uid = 1' else '' end
                 as definition
        from {all_columns} where pos = 2
        union all
        select snapshot_id, 'graphql', 'g_' || table_name, 'SELECT 1' from {all_columns} where pos = 0 and qn like '%1'""",
    "all_policies": """
        select snapshot_id, qn, 'p_' || name as policy_name,
               case when pos = 1 then 'auth.uid() = owner' when pos = 2 then 'true' end as using_expr,
               case when pos in (2, 3) and qn like '%3' then 'auth.jwt() is not null' end as with_check_expr
        from {all_columns} where pos in (1, 2, 3)""",
    "all_extensions": """
        select distinct snapshot_id, case pos when 0 then 'pgsodium' when 1 then 'vault' when 2 then 'pgcrypto'
          when 3 then 'supabase_vault' else 'uuid-ossp' end as extension
        from {all_columns} where not (snapshot_id = 'dst' and pos = 1)""",
    "comparisons": """
        select 'whole' as comparison_id, 'src' as source_snapshot_id, 'dst' as dest_snapshot_id,
               cast(null as string) as source_schema, cast(null as string) as dest_schema
        union all select 'back', 'dst', 'src', cast(null as string), cast(null as string)
        union all select 'scoped', 'src', 'dst', 'public', 'public'
        union all select 'cross', 'src', 'dst', 'public', 'archive'""",
    "part_types": "select p_partkey, p_partkey % 40 as type_no, (p_partkey * 7 + 3) % 40 as dest_type_no from {part}",
    # migration plans over the catalogs
    "plan": """
        select qn as source_table, case when table_name like '%7' then qn || 'x' else qn end as dest_table,
               case cast(substring(table_name, 2, 10) as bigint) % 3
                 when 0 then 'truncate' when 1 then 'append' else 'abort' end as conflict_mode
        from {src_columns} where pos = 0
        union all
        select 'public.gone' || table_name, qn, 'truncate' from {src_columns} where pos = 0 and qn like '%0'""",
    "source_counts": "select qn, cast(sum(pos) as bigint) as row_count from {src_columns} group by qn",
    "dest_counts": """
        select qn, cast(sum(case when qn like '%1' then 0 else 1000 * pos end) as bigint) as row_count
        from {dst_columns} group by qn""",
    # run logs
    "runs": """
        select o_orderkey as run_id, o_custkey as connection_id,
               case substring(o_orderpriority, 1, 1) when '1' then 'succeeded' when '2' then 'failed'
                 when '3' then 'cancelled' when '4' then 'running' else 'pending' end as status,
               o_orderdate as created_at,
               case when substring(o_orderpriority, 1, 1) <> '5' then o_orderdate + interval '1' hour end as started_at,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3')
                 then o_orderdate + interval '2' hour end as finished_at,
               case when substring(o_orderpriority, 1, 1) = '2' then 'lost connection'
                    when substring(o_orderpriority, 1, 1) = '3' then '' end as error,
               o_orderkey % 3 as table_count
        from {orders}""",
    "run_tables": """
        select l_orderkey as run_id, 'public.t' || cast(l_partkey as string) as source_table, l_linenumber as line,
               case when l_discount < 0.02 then 'pending' when l_discount < 0.04 then 'running'
                 when l_discount < 0.06 then 'succeeded' when l_discount < 0.08 then 'failed' else 'skipped' end as status,
               case when l_discount >= 0.02 then cast(l_quantity as bigint) end as rows_read,
               case when l_discount >= 0.04 then cast(l_quantity as bigint) end as rows_written,
               case when l_tax < 0.02 then 'slow disk' when l_tax < 0.03 then '' end as error,
               l_shipdate as started_at,
               case when l_tax > 0.05 then l_shipdate + interval '5' second end as finished_at
        from {lineitem}""",
    "checked_tables": """
        select run_id, source_table, case status when 'succeeded' then 'passed' when 'failed' then 'failed' else 'pending' end
          as status from {run_tables}""",
    "updates": """
        select user_id as run_id, event_id, ts, case event_type when 'click' then 'pending' when 'view' then 'running'
          when 'purchase' then 'succeeded' when 'error' then 'failed' else 'skipped' end as status
        from {events}""",
    "polls": """
        select poll, 'migration' as type, cast(run_id as string) as id, max(status) as status
        from (select date_trunc('day', ts) as poll, run_id, status from {updates}) u group by poll, run_id""",
    "snapshots": """
        select o_orderkey as id, o_custkey as connection_id,
               case when o_custkey % 4 <> 0 then 'db' || cast(o_custkey as string) end as connection_name,
               o_orderdate as captured_at, o_orderkey % 50 as table_count, o_orderkey % 7 as warning_count
        from {orders}""",
    "compared": """
        select o_orderkey as id, case when o_orderkey % 2 = 0 then 'public' end as source_schema,
               case when o_orderkey % 2 = 0 then 'legacy' end as dest_schema, o_orderdate as created_at,
               o_orderkey % 5 as common, o_orderkey % 2 as only_source, o_orderkey % 2 as only_dest
        from {orders}""",
    # dependency edges between parts: a tree, a few two-way pairs, repeated and self edges
    "edges": """
        select p_partkey as child, cast(floor(p_partkey / 8) as bigint) as parent from {part}
        union all select p_partkey, cast(floor(p_partkey / 8) as bigint) from {part} where p_size % 2 = 0
        union all select p_partkey, p_partkey + 1 from {part} where p_partkey % 100 = 51
        union all select p_partkey + 1, p_partkey from {part} where p_partkey % 100 = 51
        union all select p_partkey, p_partkey + 3 from {part} where p_partkey % 50 = 20""",
    "urls": """
        select page_id, case when page_id % 3 = 0 then url
          else replace(url, '://', '://user' || cast(page_id as string) || ':secret@') end as url from {pages}""",
    "marks": """
        select 'public.orders' as table_name, 'o_orderkey' as column_name, max(o_orderkey) as last_value from {orders}
        union all select 'public.customer', 'c_custkey', max(c_custkey) - 1 from {customer}
        union all select 'public.part', 'p_partkey', max(p_partkey) + 500 from {part}""",
}


PLACE = re.compile(r"\{(\w+)\}")


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(PLACE.findall(text)))


@lru_cache(maxsize=256)
def _given(spark: SparkSession, path: str) -> DataFrame:
    """The handle of a file, so that its footer is read once per session; rows are read by every query."""
    return scan(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in GIVEN:
        return _given(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    text = DERIVED[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})


def given_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f"public.{n}": table(spark, sf_dir, n) for n in GIVEN}


def columns_catalog(spark: SparkSession, sf_dir: str, name: str = "all_columns") -> DataFrame:
    """A derived column catalog with normalized types and foreign keys as structs."""
    raw = table(spark, sf_dir, name)
    return raw.withColumn("normalized_type", normalize_type(F.col("native_type"))).withColumn(
        "fk", F.when(F.col("fk_table").isNotNull(), F.struct(
            F.col("fk_schema").alias("schema_"), F.col("fk_table").alias("table"), F.col("fk_column").alias("column"))),
    ).drop("fk_schema", "fk_table", "fk_column")


def duck(text: str, *extra: str, recursive: bool = False) -> str:
    """DuckDB query with the derived tables it uses, and theirs, as common table expressions.

    ``extra`` are further common table expressions, ``name as (...)``, after the derived ones.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in order:
            return
        for n in _names(DERIVED[name]):
            visit(n)
        order.append(name)

    for part in (*extra, text):
        for n in _names(part):
            visit(n)

    def plain(part: str) -> str:
        return PLACE.sub(r"\1", part)

    parts = [f"{n} as ({plain(DERIVED[n])})" for n in order] + [plain(e) for e in extra]
    head = f"with {'recursive ' if recursive else ''}{', '.join(parts)} " if parts else ""
    return head + plain(text)
