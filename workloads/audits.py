"""Pre-flight queries."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators import audit, load, rowaudit
from tidemark.operators.audit import ForeignKey
from tidemark.operators.keyed import local_rows
from tidemark.sources.storage import scratch_path
from workloads.catalogs import SQL_SIDES
from workloads.derived import FOREIGN_KEYS, duck, table
from workloads.mappings import SQL_MAPPINGS, seeded
from workloads.registry import query


def foreign_key(spark, sf_dir, child, column, parent, parent_column, child_name=None, parent_name=None):
    return ForeignKey(f"public.{child_name or child}", table(spark, sf_dir, child), column,
                      f"public.{parent_name or parent}", table(spark, sf_dir, parent), parent_column)


def sql_orphans(child, column, parent, parent_column, child_name=None, parent_name=None) -> str:
    return (
        f"select 'public.{child_name or child}' as child_table, '{column}' as child_column, "
        f"'public.{parent_name or parent}' as parent_table, '{parent_column}' as parent_column, count(*) as orphan_rows "
        f"from {{{child}}} c where c.{column} is not null and not exists "
        f"(select 1 from {{{parent}}} p where p.{parent_column} = c.{column})")


# the keys of the given tables hold; against the thinned customers they do not
BROKEN_KEYS = [
    ("orders_child", "o_custkey", "customer_parent", "c_custkey"), ("events", "user_id", "customer_parent", "c_custkey"),
    ("lineitem", "l_orderkey", "orders_dst", "o_orderkey"), ("lineitem", "l_suppkey", "supplier_dst", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
]


@query("orphan_rows", duck(" union all ".join(sql_orphans(*fk) for fk in FOREIGN_KEYS)))
def orphan_rows(spark, sf_dir):
    return audit.orphan_rows([foreign_key(spark, sf_dir, *fk) for fk in FOREIGN_KEYS])


@query("orphan_rows_found", duck(" union all ".join(sql_orphans(*fk) for fk in BROKEN_KEYS)))
def orphan_rows_found(spark, sf_dir):
    return audit.orphan_rows([foreign_key(spark, sf_dir, *fk) for fk in BROKEN_KEYS])


def sql_orphan_findings(orphans: str) -> str:
    return (
        "select 'warning' as severity, 'preflight.orphan_rows' as code, 'Source table ' || child_table || ' has ' || "
        "format('{:,}', orphan_rows) || ' orphan row(s) — column ' || child_column || ' references ' || parent_table || '.' || "
        "parent_column || ' that doesn''t exist. With FK enforcement on (which happens when DISABLE TRIGGER fails), this "
        "table''s COPY will fail and load 0 rows. Fix on source: DELETE FROM ' || child_table || ' WHERE ' || child_column || "
        "' IS NOT NULL AND ' || child_column || ' NOT IN (SELECT ' || parent_column || ' FROM ' || parent_table || ');' "
        f"as message, 'table:' || child_table as target from ({orphans}) o where orphan_rows > 0")


@query("orphan_findings", duck(sql_orphan_findings(" union all ".join(sql_orphans(*fk) for fk in BROKEN_KEYS))))
def orphan_findings(spark, sf_dir):
    return audit.orphan_findings(audit.orphan_rows([foreign_key(spark, sf_dir, *fk) for fk in BROKEN_KEYS]))


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return audit.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys_with_nulls", duck(
    "select o_custkey, count(*) as rows from {orders_child} where o_custkey is not null group by 1 having count(*) > 1"))
def duplicate_keys_with_nulls(spark, sf_dir):
    return audit.duplicate_keys(table(spark, sf_dir, "orders_child"), ["o_custkey"])


@query("pk_collisions", duck("""
    select s.o_orderkey, count(*) as source_rows, any_value(d.n) as dest_rows from {orders} s
    join (select o_orderkey, count(*) as n from {orders_dst} group by 1) d on d.o_orderkey = s.o_orderkey
    group by s.o_orderkey"""))
def pk_collisions(spark, sf_dir):
    return audit.pk_collisions(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders_dst"), ["o_orderkey"])


@query("pk_collisions_hot_key", duck("""
    select user_id, n as source_rows, m as dest_rows from
      (select least(user_id, 20) as user_id, count(*) as n from {events} group by 1) s
      join (select o_custkey, count(*) as m from {orders_child} group by 1) d on o_custkey = user_id"""))
def pk_collisions_hot_key(spark, sf_dir):
    hot = table(spark, sf_dir, "events").select(F.least("user_id", F.lit(20)).alias("user_id"))
    orders = table(spark, sf_dir, "orders_child").select(F.col("o_custkey").alias("user_id"))
    return audit.pk_collisions(hot, orders, ["user_id"])


@query("not_null_violations", duck("""
    select column_name, null_rows from (select unnest(['run_id', 'rows_read', 'rows_written', 'error', 'finished_at']) as column_name,
      unnest([count(*) - count(run_id), count(*) - count(rows_read), count(*) - count(rows_written), count(*) - count(error),
              count(*) - count(finished_at)]) as null_rows from {run_tables}) t"""))
def not_null_violations(spark, sf_dir):
    return audit.not_null_violations(
        table(spark, sf_dir, "run_tables"), ["run_id", "rows_read", "rows_written", "error", "finished_at"])


@query("length_violations", """
    select column_name, too_long_rows from (select unnest(['p_name', 'p_brand', 'p_type']) as column_name,
      unnest([count(*) filter (length(p_name) > 8), count(*) filter (length(p_brand) > 7),
              count(*) filter (length(p_type) > 20)]) as too_long_rows from part) t""")
def length_violations(spark, sf_dir):
    return audit.length_violations(table(spark, sf_dir, "part"), {"p_name": 8, "p_brand": 7, "p_type": 20})


@query("length_violations_texts", """
    select column_name, too_long_rows from (select unnest(['text', 'lang', 'source']) as column_name,
      unnest([count(*) filter (length(text) > 255), count(*) filter (length(lang) > 2),
              count(*) filter (length(source) > 4)]) as too_long_rows from documents) t""")
def length_violations_texts(spark, sf_dir):
    return audit.length_violations(table(spark, sf_dir, "documents"), {"text": 255, "lang": 2, "source": 4})


# --- plan findings ---------------------------------------------------------------------------------------------

SQL_STATE = """state as (
    select p.source_table, p.dest_table, p.conflict_mode, s.row_count as source_rows, d.row_count as dest_rows
    from {plan} p left join {source_counts} s on s.qn = p.source_table left join {dest_counts} d on d.qn = p.dest_table)"""
SQL_FINDINGS = {
    "source_table_missing": (
        "'Source table ' || source_table || ' not found (was the source schema introspected since this comparison?).'",
        "source_table", "state where source_rows is null"),
    "dest_table_missing": (
        "'Destination table ' || dest_table || ' does not exist. Create it first (Phase 1 surfaces a DDL preview).'",
        "dest_table", "state where source_rows is not null and dest_rows is null"),
    "dest_not_empty": (
        "'Destination ' || dest_table || ' has data and conflict_mode is ''abort''.'", "dest_table",
        "state where conflict_mode = 'abort' and source_rows is not null and dest_rows > 0"),
    "will_truncate": (
        "'Destination ' || dest_table || ' will be TRUNCATEd (~' || format('{:,}', dest_rows) || ' rows lost).'", "dest_table",
        "state where conflict_mode = 'truncate' and source_rows is not null and dest_rows > 0"),
    "will_append": (
        "'Destination ' || dest_table || ' has ~' || format('{:,}', dest_rows) || "
        "' rows; new rows will be appended (PK collisions will fail mid-load).'", "dest_table",
        "state where conflict_mode = 'append' and source_rows is not null and dest_rows > 0"),
    "no_mapped_columns": (
        "'No mapped columns for ' || source_table || ' → ' || dest_table || '. Configure mappings before running.'",
        "source_table",
        "(select p.source_table, p.dest_table from {plan} p left join mappings m on m.comparison_id = 'whole' and "
        "m.source_table = p.source_table and m.dest_table = p.dest_table and m.source_column not in ('c0', 'c3') "
        "group by p.source_table, p.dest_table having count(m.source_table) = 0) c"),
}


def sql_finding(name: str) -> str:
    message, target, rows = SQL_FINDINGS[name]
    severity = fixed.FINDINGS[f"preflight.{name}"][0]
    return (f"select '{severity}' as severity, 'preflight.{name}' as code, {message} as message, "
            f"'table:' || {target} as target from {rows}")


def plan_state(spark, sf_dir):
    return audit.plan_state(table(spark, sf_dir, "plan"), table(spark, sf_dir, "source_counts"),
                            table(spark, sf_dir, "dest_counts"))


def plan_mappings(spark, sf_dir):
    """Mappings of the whole comparison with two columns of every table skipped."""
    return seeded(spark, sf_dir).filter("comparison_id = 'whole'").withColumn(
        "skip", F.col("source_column").isin("c0", "c3"))


def _register_findings():
    for name in ("source_table_missing", "dest_table_missing", "dest_not_empty", "will_truncate", "will_append"):
        @query(name, duck(sql_finding(name), SQL_STATE))
        def build(spark, sf_dir, name=name):
            return audit.plan_findings(plan_state(spark, sf_dir), [f"preflight.{name}"])


_register_findings()


@query("no_mapped_columns", duck(sql_finding("no_mapped_columns"), *SQL_SIDES, SQL_MAPPINGS))
def no_mapped_columns(spark, sf_dir):
    return audit.no_mapped_columns(table(spark, sf_dir, "plan"), plan_mappings(spark, sf_dir))


@query("would_truncate_counts", duck(
    "select dest_table, max(dest_rows) as rows_lost from state where conflict_mode = 'truncate' and source_rows is not null "
    "and dest_rows > 0 group by dest_table", SQL_STATE))
def would_truncate_counts(spark, sf_dir):
    return audit.would_truncate_counts(plan_state(spark, sf_dir))


@query("dest_column_missing", duck("""
    select distinct 'error' as severity, 'preflight.dest_column_missing' as code,
           'Destination ' || m.dest_table || ' has no column ' || m.dest_column || '.' as message,
           'column:' || m.dest_table || '.' || m.dest_column as target
    from mappings m where m.comparison_id = 'whole' and m.source_column not in ('c0', 'c3') and not exists (
      select 1 from {dst_columns} d where d.qn = m.dest_table and d.name = m.dest_column)""", *SQL_SIDES, SQL_MAPPINGS))
def dest_column_missing(spark, sf_dir):
    return audit.dest_column_missing(plan_mappings(spark, sf_dir), table(spark, sf_dir, "dst_columns"))


SQL_ALL = " union all ".join(sql_finding(n) for n in SQL_FINDINGS)
SQL_PREFLIGHT_CTES = (SQL_STATE, *SQL_SIDES, SQL_MAPPINGS, f"findings as ({SQL_ALL})")


def preflight_of(spark, sf_dir):
    return audit.preflight(
        table(spark, sf_dir, "plan"), table(spark, sf_dir, "source_counts"), table(spark, sf_dir, "dest_counts"),
        plan_mappings(spark, sf_dir))


@query("preflight", duck("select * from findings", *SQL_PREFLIGHT_CTES))
def preflight(spark, sf_dir):
    return preflight_of(spark, sf_dir)


@query("can_run", duck("select not coalesce(bool_or(severity = 'error'), false) as can_run from findings", *SQL_PREFLIGHT_CTES))
def can_run(spark, sf_dir):
    return audit.can_run(preflight_of(spark, sf_dir))


@query("finding_rollup", duck(
    "select severity, code, count(*) as findings from findings group by severity, code", *SQL_PREFLIGHT_CTES))
def finding_rollup(spark, sf_dir):
    return audit.finding_rollup(preflight_of(spark, sf_dir))


@query("finding_rollup_wiped", duck(
    """select row_number() over (order by list_position(['error', 'warning', 'info'], severity), findings desc, code) as position,
              severity, code, findings, case when code = 'preflight.will_truncate' then (select coalesce(sum(lost), 0)::bigint from (
                select max(dest_rows) as lost from state where conflict_mode = 'truncate' and source_rows is not null and dest_rows > 0
                group by dest_table) w) else 0 end as rows_wiped
       from (select severity, code, count(*) as findings from findings group by severity, code) g""", *SQL_PREFLIGHT_CTES))
def finding_rollup_wiped(spark, sf_dir):
    return audit.wiped_rollup(preflight_of(spark, sf_dir), plan_state(spark, sf_dir))


# --- audits of incoming rows --------------------------------------------------------------------------------------

# what the destination declares: column, type, nullable, part of the key; then SQL conditions of too long, rejected and changed values
INCOMING = {
    "events": [
        ("event_id", "bigint", False, True, None, "false", "false"), ("user_id", "smallint", False, False, None, "user_id > 32767", "false"),
        ("event_type", "varchar(5)", True, False, "length(event_type) > 5", None, None),
        ("ts", "date", True, False, None, "false", "ts::date::timestamp <> ts"),
        ("value", "bigint", True, False, None, "false", "cast(value as bigint)::double <> value")],
    "part": [
        ("p_partkey", "integer", False, True, None, "false", "false"), ("p_name", "character varying(8)", False, False, "length(p_name) > 8", None, None),
        ("p_brand", "char(7)", True, False, "length(p_brand) > 7", None, None)],
    "orders_child": [
        ("o_orderkey", "bigint", False, False, None, "false", "false"), ("o_custkey", "bigint", False, True, None, "false", "false")],
    "orders": [("o_orderkey", "bigint", False, True, None, "false", "false"), ("o_orderstatus", "text", False, False, None, "false", "false")],
    "region": [("r_regionkey", "smallint", False, True, None, "false", "false"), ("r_name", "varchar(6)", True, False, "length(r_name) > 6", None, None)],
}
# rows that an append would meet
PRESENT = {"orders": "orders_dst", "part": "part"}


def incoming(spark, sf_dir):
    """The whole tables with what a catalog of their destinations declares."""
    rows = [(f"public.{t}", i, c[0], c[1], c[2], c[3], False) for t, columns in INCOMING.items() for i, c in enumerate(columns)]
    catalog = local_rows(spark, rows, pa.schema([
        ("qn", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("native_type", pa.string()), ("nullable", pa.bool_()),
        ("is_pk", pa.bool_()), ("is_generated", pa.bool_())]))
    declared = rowaudit.declared_columns(catalog, [f"public.{t}" for t in INCOMING])
    return [rowaudit.Incoming(
        f"public.{t}", table(spark, sf_dir, t), *declared[f"public.{t}"],
        present=table(spark, sf_dir, PRESENT[t]) if t in PRESENT else None) for t in INCOMING]


def sql_column_audits() -> str:
    parts = []
    for t, columns in INCOMING.items():
        for name, kind, nullable, _, long, rejected, changed in columns:
            counts = [f"count(*) filter ({c})" if c else "0" for c in (None if nullable else f"{name} is null", long, rejected, changed)]
            parts.append(f"select 'public.{t}' as table_name, '{name}' as column_name, '{kind}' as dest_type, {counts[0]} as null_rows, "
                         f"{counts[1]} as too_long_rows, {counts[2]} as rejected_rows, {counts[3]} as changed_rows from {{{t}}}")
    return " union all ".join(parts)


def sql_key_audits() -> str:
    parts = []
    for t, columns in INCOMING.items():
        key = next(c[0] for c in columns if c[3])
        met = f"(select count(distinct s.{key}) from {{{t}}} s join {{{PRESENT[t]}}} d on d.{key} = s.{key})" if t in PRESENT else "0"
        parts.append(
            f"select 'public.{t}' as table_name, '{key}' as key_columns, (select count(*) from {{{t}}} where {key} is null) as null_keys, "
            f"(select count(*) from (select {key} from {{{t}}} where {key} is not null group by 1 having count(*) > 1) x) as duplicate_keys, "
            f"{met} as colliding_keys")
    return " union all ".join(parts)


SQL_ROW_FINDINGS = """
    select f.severity as severity, 'preflight.' || f.code as code, f.message as message, target from (
      select unnest([
        struct_pack(n := null_rows, severity := 'error', code := 'null_values',
          message := table_name || ': ' || format('{:,}', null_rows) || ' row(s) have no value for ' || column_name || ', which the destination declares NOT NULL.'),
        struct_pack(n := too_long_rows, severity := 'error', code := 'values_too_long',
          message := table_name || ': ' || format('{:,}', too_long_rows) || ' value(s) of ' || column_name || ' are longer than ' || dest_type || ' allows.'),
        struct_pack(n := rejected_rows, severity := 'error', code := 'values_rejected',
          message := table_name || ': ' || format('{:,}', rejected_rows) || ' value(s) of ' || column_name || ' cannot be cast to ' || dest_type || '.'),
        struct_pack(n := changed_rows, severity := 'warning', code := 'values_changed',
          message := table_name || ': ' || format('{:,}', changed_rows) || ' value(s) of ' || column_name || ' change when cast to ' || dest_type || '.')]) as f,
        'column:' || table_name || '.' || column_name as target from column_counts) c where f.n > 0
    union all
    select f.severity as severity, 'preflight.' || f.code as code, f.message as message, target from (
      select unnest([
        struct_pack(n := null_keys, severity := 'error', code := 'null_keys',
          message := table_name || ': ' || format('{:,}', null_keys) || ' row(s) have no whole key (' || key_columns || ').'),
        struct_pack(n := duplicate_keys, severity := 'error', code := 'duplicate_keys',
          message := table_name || ': ' || format('{:,}', duplicate_keys) || ' key(s) of (' || key_columns || ') occur more than once in the incoming rows.'),
        struct_pack(n := colliding_keys, severity := 'error', code := 'key_collisions',
          message := table_name || ': ' || format('{:,}', colliding_keys) || ' key(s) of (' || key_columns ||
            ') are in the destination already; appending would double them.')]) as f,
        'table:' || table_name as target from key_counts) k where f.n > 0"""
SQL_ROW_CTES = (f"column_counts as ({sql_column_audits()})", f"key_counts as ({sql_key_audits()})")


@query("column_audits", duck(sql_column_audits()))
def column_audits(spark, sf_dir):
    # a text that is too long is not told of as changed
    return rowaudit.column_audits(incoming(spark, sf_dir))


@query("key_audits", duck(sql_key_audits()))
def key_audits(spark, sf_dir):
    return rowaudit.key_audits(incoming(spark, sf_dir))


@query("preflight_audits", duck(f"select * from findings union all ({SQL_ROW_FINDINGS})", *SQL_PREFLIGHT_CTES, *SQL_ROW_CTES))
def preflight_audits(spark, sf_dir):
    """A plan's findings with those about the rows of the tables that it loads."""
    return audit.preflight(
        table(spark, sf_dir, "plan"), table(spark, sf_dir, "source_counts"), table(spark, sf_dir, "dest_counts"),
        plan_mappings(spark, sf_dir), rows=rowaudit.row_findings(incoming(spark, sf_dir)))


@query("append_refused", duck("""
    select 'public.orders: ' || format('{:,}', count(*)) || ' key(s) of (o_orderkey) are in the destination already; appending would double them.'
             as error, (select count(*) from {orders_dst}) as rows
    from (select distinct o_orderkey from {orders} join {orders_dst} using (o_orderkey)) t"""))
def append_refused(spark, sf_dir):
    """Orders appended to a destination that holds most of them: refused, and the destination stays as it was."""
    path = scratch_path(spark, "append")
    old, new = table(spark, sf_dir, "orders_dst"), table(spark, sf_dir, "orders")
    old.write.parquet(path)
    error = None
    try:
        load.load(new.select(*old.columns), path, "append", "public.orders", f"{sf_dir}/orders.parquet", key=("o_orderkey",), not_null=("o_orderdate",))
    except RuntimeError as e:
        error = str(e)
    return spark.read.parquet(path).agg(F.lit(error).alias("error"), F.count("*").alias("rows"))


LIVE = ("orders", "events", "lineitem", "customer", "nation")
# nation's mappings are all skipped and events has none
UNMAPPED = ("events", "nation")


@query("preflight_rows", duck(
    " union all ".join(
        f"select 'warning' as severity, 'preflight.will_truncate' as code, 'Destination public.{n} will be TRUNCATEd (~' || "
        f"format('{{:,}}', count(*)) || ' rows lost).' as message, 'table:public.{n}' as target from {n}".replace("{{:,}}", "{:,}")
        for n in LIVE)
    + " union all " + " union all ".join(
        f"select 'error', 'preflight.no_mapped_columns', 'No mapped columns for public.{n} → public.{n}. Configure mappings "
        f"before running.', 'table:public.{n}' from (select count(*) from {n}) t" for n in UNMAPPED)
    + " union all " + sql_orphan_findings(" union all ".join(
        sql_orphans(*fk, child_name=fk[0].replace("_child", ""), parent_name=fk[2].split("_")[0]) for fk in BROKEN_KEYS))))
def preflight_rows(spark, sf_dir):
    """All findings over the rows themselves: table counts, and orphans of every foreign key."""
    from tidemark.operators.keyed import local_rows, strings, union_all
    from tidemark.sources.catalog import table_stats

    plan = local_rows(spark, [(f"public.{n}", f"public.{n}", "truncate") for n in LIVE],
                      strings("source_table", "dest_table", "conflict_mode"))
    stats = table_stats({f"public.{n}": table(spark, sf_dir, n) for n in LIVE})
    keys = [foreign_key(spark, sf_dir, *fk, child_name=fk[0].replace("_child", ""), parent_name=fk[2].split("_")[0])
            for fk in BROKEN_KEYS]
    mappings = union_all([
        table(spark, sf_dir, n).groupBy().agg(F.count("*")).select(
            F.lit(f"public.{n}").alias("source_table"), F.lit(f"public.{n}").alias("dest_table"),
            F.explode(F.array(*[F.lit(c) for c in table(spark, sf_dir, n).columns])).alias("source_column"),
            F.lit(n == "nation").alias("skip")) for n in LIVE if n != "events"])
    return audit.preflight(plan, stats, stats, mappings, keys)

