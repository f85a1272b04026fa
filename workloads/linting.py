"""Lint queries and the comparison report, which shows their notes."""

from pyspark.sql import functions as F

from tidemark.operators import drift, lint
from workloads.catalogs import CTES, SOURCE_LABEL, DEST_LABEL, SQL_SUMMARY, snapshot_labels
from workloads.derived import columns_catalog, duck, table
from workloads.registry import query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HELPER = r"'\bauth\.(uid|role|jwt|email)\s*\(', 'i'"
RANDOM_UUID = r"'\bgen_random_uuid\s*\(', 'i'"
SQL_RULES = {
    "schemas_present": ("supabase.schemas_present", """
        select snapshot_id, 'Supabase-managed schemas detected: [' || string_agg('''' || schema_name || '''', ', ' order by
          schema_name) || ']. Decide per schema whether to skip, migrate verbatim, or transform.' as message, null as target
        from (select distinct snapshot_id, schema_name from {all_tables} union select snapshot_id, schema_name from {all_views}) s
        where schema_name in ('auth', 'storage', 'realtime', '_supabase', 'vault', 'pgsodium', 'extensions', 'graphql',
          'graphql_public') group by snapshot_id"""),
    "managed_extensions": ("supabase.extension_only_in_supabase", """
        select snapshot_id, 'Extension `' || extension || '` is Supabase-specific; vanilla Postgres won''t have it.' as message,
               'extension:' || extension as target from {all_extensions}
        where extension in ('pgsodium', 'vault', 'supabase_vault')"""),
    "random_uuid_defaults": ("supabase.gen_random_uuid_default", f"""
        select snapshot_id, 'Column `' || qn || '.' || name || '` defaults to gen_random_uuid(). Ensure pgcrypto is installed '
          || 'on the destination, or use Postgres 14+ where it is built-in.' as message,
          'column:' || qn || '.' || name as target
        from {{all_columns}} where regexp_matches(default_expr, {RANDOM_UUID})"""),
    "fk_to_managed_users": ("supabase.fk_to_auth_users", """
        select snapshot_id, 'Column `' || qn || '.' || name || '` references auth.users. If the destination has no Supabase '
          || 'auth, the FK will be unsatisfiable — either migrate auth.users, flatten into a destination users table, '
          || 'or drop the constraint.' as message, 'column:' || qn || '.' || name as target
        from {all_columns} where fk_schema = 'auth' and fk_table = 'users'"""),
    "row_security": ("supabase.rls_enabled", """
        select snapshot_id, 'RLS is enabled on `' || qn || '`. Decide whether to migrate policies as-is or strip them on '
          || 'the destination.' as message, 'table:' || qn as target from {all_tables} where rls_enabled"""),
    "policies_with_helpers": ("supabase.policy_uses_auth_helper", f"""
        select snapshot_id, 'RLS policy `' || policy_name || '` on `' || qn || '` calls auth.uid() / auth.role() / auth.jwt(). '
          || 'These functions are provided by Supabase GoTrue — the destination needs equivalents.' as message,
          'policy:' || qn || '.' || policy_name as target from {{all_policies}}
        where regexp_matches(coalesce(using_expr, ''), {HELPER}) or regexp_matches(coalesce(with_check_expr, ''), {HELPER})"""),
    "views_with_helpers": ("supabase.view_uses_auth_helper", f"""
        select snapshot_id, 'View `' || schema_name || '.' || view_name || '` references Supabase auth helpers. Replace or '
          || 'stub them on the destination.' as message, 'view:' || schema_name || '.' || view_name as target
        from {{all_views}} where regexp_matches(definition, {HELPER})"""),
}


SEVERITY = {"schemas_present": "info", "random_uuid_defaults": "info", "row_security": "info"}


def sql_rule(name: str) -> str:
    code, rows = SQL_RULES[name]
    return (f"select snapshot_id, '{SEVERITY.get(name, 'warning')}' as severity, '{code}' as code, message, target "
            f"from ({rows}) r_{name}")


SQL_NOTES = f"notes as ({' union all '.join(sql_rule(n) for n in SQL_RULES)})"
SQL_GUIDED = "guided as (select n.*, g.guidance from notes n left join {guidance} g on g.code = n.code)"
INPUTS = {
    "schemas_present": ("all_tables", "all_views"), "managed_extensions": ("all_extensions",),
    "random_uuid_defaults": ("columns",), "fk_to_managed_users": ("columns",), "row_security": ("all_tables",),
    "policies_with_helpers": ("all_policies",), "views_with_helpers": ("all_views",),
}


def given(spark, sf_dir, name):
    return columns_catalog(spark, sf_dir) if name == "columns" else table(spark, sf_dir, name)


def _register_rules():
    for name, inputs in INPUTS.items():
        @query(f"lint_{name}", duck(sql_rule(name)))
        def build(spark, sf_dir, name=name, inputs=inputs):
            return getattr(lint, name)(*[given(spark, sf_dir, n) for n in inputs])


_register_rules()


def warnings_of(spark, sf_dir):
    return lint.lint(*[given(spark, sf_dir, n) for n in ("all_tables", "columns", "all_views", "all_policies", "all_extensions")])


@query("lint_report", duck("select * from guided", SQL_NOTES, SQL_GUIDED))
def lint_report(spark, sf_dir):
    return lint.with_guidance(warnings_of(spark, sf_dir), table(spark, sf_dir, "guidance"))


@query("lint_rollup", duck("select snapshot_id, severity, count(*) as warnings from notes group by 1, 2", SQL_NOTES))
def lint_rollup(spark, sf_dir):
    return lint.severity_rollup(warnings_of(spark, sf_dir))


PAGE_RULES = [
    lint.Rule("page.script", "warning", "html", r"(?i)<script\b", "page runs a script"),
    lint.Rule("page.query_url", "info", "url", r"\?[^#]*=", "url carries parameters"),
    lint.Rule("page.entity", "info", "html", r"&(amp|lt|gt|quot);", "html entities in text"),
    lint.Rule("page.comment", "warning", "html", r"<!--", "html comment"),
]
DOCUMENT_RULES = [
    lint.Rule("text.email", "error", "text", r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}", "e-mail address"),
    lint.Rule("text.license", "info", "text", r"(?i)\b(license|copyright)\b", "license line"),
    lint.Rule("text.digits", "info", "text", r"[0-9]{4,}", "long number"),
]


def sql_scan(given_table: str, key: str, rules) -> str:
    def literal(pattern):
        return quoted(pattern[4:] if pattern.startswith("(?i)") else pattern) + (", 'i'" if pattern.startswith("(?i)") else "")

    return " union all ".join(
        f"select {key}, '{r.severity}' as severity, '{r.code}' as code, '{r.message}' as message, '{r.column}' as column_name "
        f"from {given_table} where regexp_matches({r.column}, {literal(r.pattern)})" for r in rules)


@query("rule_scan_pages", sql_scan("pages", "page_id", PAGE_RULES))
def rule_scan_pages(spark, sf_dir):
    return lint.rule_scan(table(spark, sf_dir, "pages"), ["page_id"], PAGE_RULES)


@query("rule_scan_documents", sql_scan("documents", "doc_id", DOCUMENT_RULES))
def rule_scan_documents(spark, sf_dir):
    return lint.rule_scan(table(spark, sf_dir, "documents"), ["doc_id"], DOCUMENT_RULES)


SQL_SCOPED = """scope as (select *, source_schema as s, dest_schema as d from {comparisons})"""
SQL_REPORT = f"""
    select comparison_id, 0 as section_rank, 'scope' as section, 'scope' as item, 0 as rank,
           case when s is null then 'all non-system schemas (whole-DB diff)' when s = d then 'schema ' || s || ' on both sides'
             else 'schema ' || s || ' (source) → ' || d || ' (destination)' end as detail from scope
    union all
    select comparison_id, 1, 'databases', side, i, 'db ' || snap || ': ' ||
           (select count(*) from {{all_tables}} t where t.snapshot_id = snap) || ' tables, ' ||
           (select count(*) from {{all_views}} t where t.snapshot_id = snap) || ' views, ' ||
           (select count(*) from {{all_policies}} t where t.snapshot_id = snap) || ' policies'
    from (select comparison_id, 'source' as side, 0 as i, source_snapshot_id as snap from scope
          union all select comparison_id, 'dest', 1, dest_snapshot_id from scope) b
    union all select comparison_id, 2, 'summary', 'common_tables', 0, common_tables::varchar from summary
    union all select comparison_id, 2, 'summary', 'only_in_source', 1, only_in_source::varchar from summary
    union all select comparison_id, 2, 'summary', 'only_in_dest', 2, only_in_dest::varchar from summary
    union all select comparison_id, 2, 'summary', 'tables_with_drift', 3, tables_with_drift::varchar from summary
    union all select comparison_id, 2, 'summary', 'drift_rows', 4, drift_rows::varchar from summary
    union all select comparison_id, 3, 'only_in_source', {SOURCE_LABEL}, 0, '' from presence where in_source and not in_dest
    union all select comparison_id, 4, 'only_in_dest', {DEST_LABEL}, 0, '' from presence where in_dest and not in_source
    union all select comparison_id, 5, 'drift', table_label, kind_rank, column_name || ' | ' || replace(kind, '_', ' ') || ' | ' ||
           coalesce(source_value, '') || ' | ' || coalesce(dest_value, '') from drift
    union all select c.comparison_id, 6, 'notes_source', n.code, 0, concat_ws(' ', '[' || upper(n.severity) || ']', n.target,
           n.message, n.guidance) from scope c join guided n on n.snapshot_id = c.source_snapshot_id
    union all select c.comparison_id, 7, 'notes_dest', n.code, 0, concat_ws(' ', '[' || upper(n.severity) || ']', n.target,
           n.message, n.guidance) from scope c join guided n on n.snapshot_id = c.dest_snapshot_id"""


@query("comparison_report", duck(SQL_REPORT, *CTES, SQL_SUMMARY, SQL_SCOPED, SQL_NOTES, SQL_GUIDED))
def comparison_report(spark, sf_dir):
    return drift.comparison_report(
        table(spark, sf_dir, "comparisons"), columns_catalog(spark, sf_dir), table(spark, sf_dir, "all_tables"),
        snapshot_labels(spark, sf_dir), lint.with_guidance(warnings_of(spark, sf_dir), table(spark, sf_dir, "guidance")))


@query("lint_clean_rows", duck(f"""
    select snapshot_id, qn, name from {{all_columns}} where not regexp_matches(coalesce(default_expr, ''), {RANDOM_UUID})
      and (fk_table is null or fk_schema <> 'auth' or fk_table <> 'users')"""))
def lint_clean_rows(spark, sf_dir):
    """Columns no column rule fires on."""
    columns = columns_catalog(spark, sf_dir)
    fired = lint.random_uuid_defaults(columns).unionByName(lint.fk_to_managed_users(columns)).select(
        "snapshot_id", "target").distinct()
    return columns.withColumn("target", F.concat(F.lit("column:"), "qn", F.lit("."), "name")).join(
        fired, ["snapshot_id", "target"], "left_anti").select("snapshot_id", "qn", "name")
