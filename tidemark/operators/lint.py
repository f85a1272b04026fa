"""Rules over catalogs and over any text column, as warnings with code, severity, message and target."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import qualified, quoted
from tidemark.operators.keyed import union_all

WARNING = ["snapshot_id", "severity", "code", "message", "target"]


#: What a pass over one catalog table finds: warnings, and for the schema rule the schemas that belong in its message.
_HIT = "struct<severity:string,code:string,message:string,target:string,schema_name:string>"


def _hit(code: str, when: Column, *values: Column, target: Column | None = None, schema: Column | None = None) -> Column:
    """The verdict of one rule on one row of a catalog: null where it does not fire."""
    severity, template = fixed.LINT_RULES[code]
    message = F.lit(None) if schema is not None else F.format_string(template, *values)
    return F.when(when, F.struct(
        F.lit(severity), F.lit(code), message, target if target is not None else F.lit(None),
        schema if schema is not None else F.lit(None)).cast(_HIT))


def _target(kind: str, *path: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(".", *path))


def _scan(rows: DataFrame, *hits: Column) -> DataFrame:
    """The verdicts of all rules on one catalog table, in one pass."""
    return rows.select("snapshot_id", F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select("snapshot_id", "_hit.*")


def _settled(hits: DataFrame) -> DataFrame:
    """Warnings of all hits; those of the schema rule become one per snapshot. Only hits are shuffled."""
    # a set holds at most the managed schemas of the fixed list
    found = hits.groupBy("snapshot_id", "severity", "code", "message", "target").agg(
        F.sort_array(F.collect_set("schema_name")).alias("_found"), F.count("*").alias("_times"))
    listed = F.array_join(F.transform("_found", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    several = F.size("_found") > 0
    template = fixed.LINT_RULES["supabase.schemas_present"][1]
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(several, 1).otherwise(F.col("_times"))))).select(
        "snapshot_id", "severity", "code", F.when(several, F.format_string(template, listed)).otherwise(F.col("message")).alias("message"),
        "target")


def _schema_hit() -> Column:
    name = F.col("schema_name")
    return _hit("supabase.schemas_present", name.isin(fixed.MANAGED_SCHEMAS), schema=name)


def _extension_hit() -> Column:
    name = F.col("extension")
    return _hit("supabase.extension_only_in_supabase", name.isin(fixed.MANAGED_EXTENSIONS), name, target=_target("extension", name))


def _uuid_hit() -> Column:
    path = qualified(F.col("qn"), F.col("name"))
    return _hit("supabase.gen_random_uuid_default", F.col("default_expr").rlike(fixed.RANDOM_UUID_PATTERN), path,
                target=_target("column", path))


def _users_hit() -> Column:
    path = qualified(F.col("qn"), F.col("name"))
    return _hit("supabase.fk_to_auth_users", (F.col("fk.schema_") == "auth") & (F.col("fk.table") == "users"), path,
                target=_target("column", path))


def _row_security_hit() -> Column:
    return _hit("supabase.rls_enabled", F.col("rls_enabled"), F.col("qn"), target=_target("table", F.col("qn")))


def _policy_hit() -> Column:
    def calls(expr: str) -> Column:
        return F.coalesce(F.col(expr), F.lit("")).rlike(fixed.AUTH_HELPER_PATTERN)

    return _hit("supabase.policy_uses_auth_helper", calls("using_expr") | calls("with_check_expr"), F.col("policy_name"), F.col("qn"),
                target=_target("policy", F.col("qn"), F.col("policy_name")))


def _view_hit() -> Column:
    path = qualified(F.col("schema_name"), F.col("view_name"))
    return _hit("supabase.view_uses_auth_helper", F.col("definition").rlike(fixed.AUTH_HELPER_PATTERN), path,
                target=_target("view", path))


def schemas_present(tables: DataFrame, views: DataFrame) -> DataFrame:
    """One row per snapshot that has a managed schema, naming all of them."""
    return _settled(union_all([_scan(tables, _schema_hit()), _scan(views, _schema_hit())]))


def managed_extensions(extensions: DataFrame) -> DataFrame:
    return _scan(extensions, _extension_hit()).select(*WARNING)


def random_uuid_defaults(columns: DataFrame) -> DataFrame:
    return _scan(columns, _uuid_hit()).select(*WARNING)


def fk_to_managed_users(columns: DataFrame) -> DataFrame:
    return _scan(columns, _users_hit()).select(*WARNING)


def row_security(tables: DataFrame) -> DataFrame:
    return _scan(tables, _row_security_hit()).select(*WARNING)


def policies_with_helpers(policies: DataFrame) -> DataFrame:
    """policies: snapshot_id, qn, policy_name, using_expr, with_check_expr; once per policy."""
    return _scan(policies, _policy_hit()).select(*WARNING)


def views_with_helpers(views: DataFrame) -> DataFrame:
    return _scan(views, _view_hit()).select(*WARNING)


def lint(
    tables: DataFrame, columns: DataFrame, views: DataFrame, policies: DataFrame, extensions: DataFrame,
) -> DataFrame:
    """All seven rules over all snapshots; each of the five tables is read once."""
    return _settled(union_all([
        _scan(tables, _schema_hit(), _row_security_hit()), _scan(columns, _uuid_hit(), _users_hit()),
        _scan(views, _schema_hit(), _view_hit()), _scan(policies, _policy_hit()), _scan(extensions, _extension_hit())]))


def with_guidance(warnings: DataFrame, guidance: DataFrame) -> DataFrame:
    """Warnings with the text that guidance(code, guidance) has for their code; null for a code without one."""
    texts = guidance.groupBy("code").agg(F.min("guidance").alias("guidance"))
    return warnings.join(texts, ["code"], "left").select(*WARNING, "guidance")


def severity_rollup(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("snapshot_id", "severity").agg(F.count("*").alias("warnings"))


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    column: str
    pattern: str
    message: str


def rule_scan(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Every rule whose pattern matches a row, one output row per match; a single pass over the whole texts."""
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(quoted(r.column).rlike(r.pattern), F.lit(False)), F.struct(
            F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.lit(r.message).alias("message"),
            F.lit(r.column).alias("column_name")))
        for r in rules]))
    return df.select(*[quoted(k) for k in key], F.explode(hits).alias("_hit")).select(
        *[quoted(k) for k in key], "_hit.*")
