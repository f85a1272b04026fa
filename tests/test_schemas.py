"""Drift, mapping, projection, lint and catalogs on small catalogs of our own."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.types import normalize_type
from tidemark.operators import drift, lint, mapping, projection
from tidemark.sources import catalog

COLUMN = ("snapshot_id string, schema_name string, table_name string, pos int, name string, native_type string, "
          "nullable boolean, default_expr string, is_pk boolean, fk struct<schema_:string,table:string,column:string>, "
          "is_generated boolean")


def col(table, name, native="text", nullable=True, default=None, pk=False, fk=None, snapshot="s"):
    schema, bare = table.split(".")
    return (snapshot, schema, bare, 0, name, native, nullable, default, pk, fk, False)


def columns(spark, *rows):
    df = spark.createDataFrame(list(rows), COLUMN)
    return df.withColumn("qn", F.concat_ws(".", "schema_name", "table_name")).withColumn(
        "normalized_type", normalize_type(F.col("native_type")))


def found(df):
    rows = df.orderBy("table_label", "phase", "column_name", "kind_rank").collect()
    return [(r["table_label"], r["column_name"], r["kind"], r["source_value"], r["dest_value"]) for r in rows]


USERS = ("auth", "users", "id")


def source_db(spark):
    return columns(
        spark, col("auth.users", "id", "uuid", False, "gen_random_uuid()", True), col("auth.users", "email", "text", False),
        col("storage.buckets", "id", "text", False, None, True),
        col("public.profiles", "id", "uuid", False, None, True, USERS),
        col("public.posts", "id", "uuid", False, "gen_random_uuid()", True),
        col("public.posts", "author_id", "uuid", False, None, False, USERS),
        col("public.posts", "title", "VARCHAR(255)", False), col("public.posts", "metadata", "jsonb", True, "'{}'::jsonb"),
        col("public.posts", "view_count", "bigint", False, "0"),
        col("public.posts", "created_at", "timestamp with time zone", False, "now()"))


def dest_db(spark):
    return columns(
        spark, col("public.posts", "id", "uuid", False, None, True), col("public.posts", "author_id", "uuid", False),
        col("public.posts", "title", "VARCHAR(255)", False), col("public.posts", "created_at", "timestamp", False, "now()"),
        col("public.posts", "extra", "integer"))


def test_drift_of_two_databases(spark):
    fk = '{"schema_":"auth","table":"users","column":"id"}'
    assert found(drift.compare(source_db(spark), dest_db(spark))) == [
        ("public.posts", "metadata", "missing_in_dest", None, None),
        ("public.posts", "view_count", "missing_in_dest", None, None),
        ("public.posts", "extra", "missing_in_source", None, None),
        ("public.posts", "author_id", "fk_changed", fk, None),
        ("public.posts", "created_at", "type_changed", "timestamp with time zone (timestamptz)", "timestamp (timestamp)"),
        ("public.posts", "id", "default_changed", "gen_random_uuid()", None)]


def test_all_kinds_of_one_column(spark):
    a = columns(spark, col("public.t", "c", "text", True, None, False))
    b = columns(spark, col("public.t", "c", "varchar(9)", False, "'x'", True, ("public", "p", "id")))
    assert [r[2:] for r in found(drift.compare(a, b))] == [
        ("type_changed", "text (string)", "varchar(9) (string)"), ("nullable_changed", "True", "False"),
        ("default_changed", None, "'x'"), ("pk_changed", "False", "True"),
        ("fk_changed", None, '{"schema_":"public","table":"p","column":"id"}')]


def test_no_drift_with_itself(spark):
    assert found(drift.compare(source_db(spark), source_db(spark))) == []


def test_scope(spark):
    a = columns(spark, col("app.t", "x"), col("app.only", "x"), col("public.t", "y"))
    b = columns(spark, col("legacy.t", "x", "bigint"), col("legacy.extra", "x"), col("public.t", "z"))
    assert found(drift.compare(a, b, "app", "legacy")) == [("app.t", "x", "type_changed", "text (string)", "bigint (int64)")]
    with pytest.raises(ValueError):
        drift.compare(a, b, "app", None)
    pair = spark.createDataFrame([("c", "s", "d", "app", "")], "comparison_id string, source_snapshot_id string, "
                                 "dest_snapshot_id string, source_schema string, dest_schema string")
    with pytest.raises(PySparkException):
        drift.schema_drift(a, catalog.tables_of(a), pair).collect()


def test_presence_labels(spark):
    a = columns(spark, col("app.t", "x"), col("app.only", "x"))
    b = columns(spark, col("legacy.t", "x", snapshot="d"), col("legacy.extra", "x", snapshot="d"))
    pair = spark.createDataFrame([("c", "s", "d", "app", "legacy")], "comparison_id string, source_snapshot_id string, "
                                 "dest_snapshot_id string, source_schema string, dest_schema string")
    presence = drift.table_presence(catalog.tables_of(a).union(catalog.tables_of(b)), pair)
    assert [r["table_label"] for r in drift.tables_only_in_source(presence).collect()] == ["app.only"]
    assert [r["table_label"] for r in drift.tables_only_in_dest(presence).collect()] == ["legacy.extra"]
    assert [r["table_label"] for r in drift.common_tables(presence).collect()] == ["app.t → legacy.t"]


def test_lossy_and_default_types(spark):
    pairs = [("float64", "float32", True), ("int32", "int16", True), ("timestamptz", "date", True), ("date", "timestamp", False),
             ("uuid", "uuid", False), ("int16", "int32", False), ("unknown", "string", False)]
    df = spark.createDataFrame(pairs, "a string, b string, lossy boolean")
    assert df.filter(mapping.is_lossy(F.col("a"), F.col("b")) != F.col("lossy")).collect() == []
    types = spark.createDataFrame(
        [("postgres", "varchar(9)", "string"), ("x", "varchar(9)", "string"), ("x", "?", "odd")], "e string, n string, w string")
    chosen = types.select(mapping.default_dest_type(F.col("e"), F.col("n"), F.col("w"), F.lit("postgres"))).collect()
    assert [r[0] for r in chosen] == ["varchar(9)", "text", "text"]


def m(column, source_type="text", dest=None, default=None, override=None, skip=False):
    return {"source_column": column, "dest_column": column if dest is None else dest, "source_type": source_type,
            "default_dest_type": default or source_type, "override_dest_type": override, "skip": skip}


PLANNED = [
    # (mapping, cast type or None if the column keeps its type, written)
    (dict(column="k", source_type="bigint"), None, True),
    (dict(column="k", source_type="bigint", dest="key_2", override="smallint"), "smallint", True),
    (dict(column="k", source_type="bigint", override="  bigint "), None, True),
    (dict(column="k", source_type=" bigint", default="bigint"), None, True),
    (dict(column="k", source_type="bigint", default="numeric(20,0)"), "numeric(20,0)", True),
    (dict(column="k", source_type="bigint", default="text", override=""), "text", True),
    (dict(column="k", source_type=None, default="text"), "text", True),
    (dict(column="k", source_type="bigint", skip=True), None, False),
    (dict(column="k", source_type="bigint", skip=None), None, True),
    (dict(column=None, source_type="bigint", dest="z"), None, False),
    (dict(column="k", source_type="bigint", dest=""), None, False),
]


def test_planned_columns(spark):
    for mapping_row, cast_to, written in PLANNED:
        df = projection._rows(spark, [m(**mapping_row)])
        got = projection.planned_columns(df).first()
        assert (got.written, got.cast_to if written else None) == (written, cast_to), mapping_row


def test_nothing_left_to_write(spark):
    df = spark.createDataFrame([(1, 2)], "k int, z int")
    with pytest.raises(ValueError, match="every mapping is skipped"):
        projection.project(df, [m("k", "integer", skip=True)])
    with pytest.raises(ValueError, match="are generated"):
        projection.project(df, [m("k", "integer"), m("z", "integer", skip=True)], ["k"], "app.t")
    assert projection.project(df, [m("k", "integer"), m("z", "integer")], ["k"], "app.t").columns == ["z"]


def test_projection_of_odd_names(spark):
    df = spark.createDataFrame([(1, 2.5, "abc")], "`co``l` int, `a.b` double, c string")
    done = projection.project(df, [m("co`l", "integer", 'x"y'), m("a.b", "double precision", "n", override="integer"),
                                   m("c", override="varchar(2)")])
    assert done.columns == ["n", "c", 'x"y'] and tuple(done.collect()[0]) == (2, "ab", 1)


def test_projection_scans_only_planned_columns(spark, table):
    done = projection.project(table("lineitem"), [m("l_orderkey", "bigint", "id"), m("l_quantity", "double precision", override="bigint")])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "Exchange" not in plan


def test_lossy_audit_counts(spark):
    df = spark.createDataFrame([(1, 1.5, "abcd"), (70000, 2.0, "ab"), (None, None, None)], "a bigint, b double, c string")
    rows = projection.lossy_audit(df, [m("a", "bigint", override="smallint"), m("b", "double precision", override="integer"),
                                       m("c", override="varchar(3)")]).collect()
    assert [tuple(r) for r in rows] == [("a", "smallint", 1, 0), ("b", "integer", 0, 1), ("c", "varchar(3)", 0, 1)]


def test_remap_keeps_row_count_with_hot_and_repeated_keys(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) as ref")
    lookup = spark.range(0, 2000).selectExpr("id as old", "id + 10000 as new").union(
        spark.createDataFrame([(7, 99999)], "old bigint, new bigint"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = {r["id"]: r["ref"] for r in projection.fk_remap(rows, "ref", lookup, "old", "new").collect()}
            assert got == {i: (10007 if i % 3 == 0 else i + 10000 if i < 2000 else i) for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def lint_codes(spark, cols=(), rls=(), views=(), policies=(), extensions=()):
    c = columns(spark, *cols) if cols else columns(spark, col("public.none", "x")).limit(0)
    tables = catalog.tables_of(c).withColumn("rls_enabled", F.col("qn").isin(list(rls)) if rls else F.lit(False))
    v = spark.createDataFrame(list(views), "snapshot_id string, schema_name string, view_name string, definition string")
    p = spark.createDataFrame(list(policies), "snapshot_id string, qn string, policy_name string, using_expr string, with_check_expr string")
    e = spark.createDataFrame(list(extensions), "snapshot_id string, extension string")
    return {r["code"].split(".")[1]: (r["severity"], r["target"]) for r in lint.lint(tables, c, v, p, e).collect()}


def test_lint_rules(spark):
    assert lint_codes(spark, [col("auth.users", "id")]) == {"schemas_present": ("info", None)}
    assert lint_codes(spark, [col("public.p", "id", default="Gen_Random_UUID ()")]) == {
        "gen_random_uuid_default": ("info", "column:public.p.id")}
    assert lint_codes(spark, [col("public.p", "id", fk=USERS)]) == {"fk_to_auth_users": ("warning", "column:public.p.id")}
    assert lint_codes(spark, [col("public.p", "id")], rls=["public.p"]) == {"rls_enabled": ("info", "table:public.p")}
    assert lint_codes(spark, policies=[("s", "public.p", "p1", "auth.uid() = x", "auth.jwt()")]) == {
        "policy_uses_auth_helper": ("warning", "policy:public.p.p1")}
    assert lint_codes(spark, policies=[("s", "public.p", "p1", None, "AUTH.role( )")]) == {
        "policy_uses_auth_helper": ("warning", "policy:public.p.p1")}
    assert lint_codes(spark, views=[("s", "public", "v", "select auth.email ()")]) == {
        "view_uses_auth_helper": ("warning", "view:public.v")}
    assert lint_codes(spark, extensions=[("s", "pgsodium"), ("s", "pgcrypto")]) == {
        "extension_only_in_supabase": ("warning", "extension:pgsodium")}


def test_clean_catalog_has_no_warnings(spark):
    clean = [col("public.p", "id", "uuid", default="uuid_generate_v4()"), col("public.p", "t", default="my_gen_random_uuid()")]
    assert lint_codes(spark, clean, views=[("s", "public", "v", "select myauth.uid")], extensions=[("s", "uuid-ossp")]) == {}


def test_catalog_of_files(spark, table):
    keys = spark.createDataFrame([("public.nation", "n_nationkey", True, None, None, False)],
                                 "qn string, name string, is_pk boolean, fk struct<schema_:string,table:string,column:string>, "
                                 "default_expr string, is_generated boolean")
    broken = table("nation").withColumn("n_name", F.raise_error(F.lit("read")).cast("string"))
    assert catalog.catalog_columns({"public.nation": broken}, keys).count() == len(broken.columns)  # schemas only
    rows = catalog.catalog_columns({"public.nation": table("nation")}, keys, observe=True).orderBy("pos").collect()
    assert [(r["name"], r["normalized_type"], r["nullable"], r["is_pk"]) for r in rows] == [
        ("n_nationkey", "int32", False, True), ("n_name", "string", False, False), ("n_regionkey", "int32", False, False)]
    assert catalog.single_pk(columns(spark, col("public.t", "a", pk=True), col("public.t", "b", pk=True))).collect()[0]["pk_column"] is None


def test_catalog_of_a_database(spark, tmp_path, table):
    spark.sql(f"create database if not exists tide_catalog location '{tmp_path}'")
    try:
        table("region").write.format("parquet").option("path", f"{tmp_path}/region").saveAsTable("tide_catalog.region")
        found = catalog.catalog_of_spark(spark, "tide_catalog")
        assert {r["qn"]: r["row_count"] for r in catalog.table_stats(found).collect()} == {"tide_catalog.region": 5}
    finally:
        spark.sql("drop database tide_catalog cascade")


def test_planned_types(spark):
    df = spark.createDataFrame([(1, 2.5, "a")], "a bigint, b double, c string")
    rows = [m("a", "bigint", override="numeric(10,2)"), m("b", "double precision", "n", override="integer"), m("c")]
    planned = projection.planned_schema(df, rows)
    assert planned == {"a": "decimal(10,2)", "n": "int", "c": "string"}
    assert {f.name: f.dataType.simpleString() for f in projection.project(df, rows).schema.fields} == planned


def test_mappings_in_order(spark):
    a = source_db(spark)
    pair = spark.createDataFrame([("c", "s", "s", None, None)], "comparison_id string, source_snapshot_id string, "
                                 "dest_snapshot_id string, source_schema string, dest_schema string")
    rows = mapping.ordered_mappings(mapping.seed_mappings(a, catalog.tables_of(a), pair)).collect()
    names = [(r["source_table"], r["source_column"]) for r in rows]
    assert names == sorted(names) and len(names) == 10 and not any(r["is_lossy"] or r["skip"] for r in rows)


def test_lint_reads_each_catalog_once(spark, tmp_path):
    shapes = {
        "tables": "1 as snapshot_id, 'auth' as schema_name, 'auth.t' as qn, true as rls_enabled",
        "columns": "1 as snapshot_id, 'auth.t' as qn, 'c' as name, 'gen_random_uuid()' as default_expr, "
                   "struct('auth' as schema_, 'users' as table, 'id' as column) as fk",
        "views": "1 as snapshot_id, 'storage' as schema_name, 'v' as view_name, 'select auth.uid()' as definition",
        "policies": "1 as snapshot_id, 'auth.t' as qn, 'p' as policy_name, 'auth.uid()' as using_expr, cast(null as string) as with_check_expr",
        "extensions": "1 as snapshot_id, 'vault' as extension"}
    frames = []
    for name, shape in shapes.items():
        # repeated rows of a catalog give repeated warnings; the schemas of a snapshot are one warning
        spark.sql(f"select {shape} from range(3)").write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    found = lint.lint(*frames)
    assert str(found._jdf.queryExecution().executedPlan()).count("FileScan") == 5 * (
        2 if "Initial Plan" in str(found._jdf.queryExecution().executedPlan()) else 1)
    times = {r.code: r["count"] for r in found.groupBy("code").count().collect()}
    assert times.pop("supabase.schemas_present") == 1 and len(times) == 6 and set(times.values()) == {3}
    assert "['auth', 'storage']" in found.filter("code = 'supabase.schemas_present'").first().message
    for empty in [lint.lint(*[f.limit(0) for f in frames])]:
        assert empty.collect() == [] and empty.columns == lint.WARNING
