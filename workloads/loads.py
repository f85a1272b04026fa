"""Load queries: they write to new folders under the shared folder and read the result back."""

from pyspark.sql import functions as F

from tidemark.operators import drift, graph, load
from tidemark.operators.projection import project
from tidemark.plans.migration import TableMove, included, run_migration
from tidemark.operators.keyed import local_rows, strings, union_all
from tidemark.sources import storage
from tidemark.sources.storage import scratch_path
from tidemark.sources.tables import scan, sink
from workloads.catalogs import SOURCE_LABEL, SQL_PRESENCE, SQL_SIDES, presence_of
from workloads.derived import KEYS, duck, table
from workloads.mappings import ORDER_MAPPINGS, m
from workloads.parity import COLUMNS
from workloads.registry import query

NATIVE = {"int": "bigint", "num": "double precision", "text": "text", "ts": "timestamp", "floats": "real[]"}


def identity(name):
    return [m(c, NATIVE[k]) for c, k in COLUMNS[name].items()]


@query("sink_roundtrip", "select o_orderkey as id, o_totalprice as total, o_orderdate::varchar as ordered from orders")
def sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "sink")
    sink(table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as total", "o_orderdate as ordered"),
         path, "errorifexists")
    return scan(spark, path, ["id", "total", "ordered"]).withColumn("ordered", F.col("ordered").cast("string"))


@query("skipped_tables", duck(
    f"select {SOURCE_LABEL} as source_table, 'Table does not exist on destination — v1 does not auto-CREATE.' as reason "
    "from presence where in_source and not in_dest and comparison_id = 'whole'", *SQL_SIDES, SQL_PRESENCE))
def skipped_tables(spark, sf_dir):
    only = drift.tables_only_in_source(presence_of(spark, sf_dir)).filter("comparison_id = 'whole'")
    return load.skipped_tables(only)


SQL_LEVELS = """
    select n.node, case when s.node is null then l.level end as level, n.node in (select a from reach where a = b) as cyclic,
           s.node is not null and n.node not in (select a from reach where a = b) as blocked
    from nodes n left join stuck s on s.node = n.node
    left join (select node, max(level) as level from depth group by node) l on l.node = n.node"""


@query("dependency_levels", duck(
    SQL_LEVELS,
    "links as (select distinct child, parent from {edges} where child <> parent)",
    "nodes as (select child as node from {edges} union select parent from {edges})",
    "reach as (select child as a, parent as b from links union select r.a, l.parent from reach r join links l on l.child = r.b)",
    "stuck as (select distinct a as node from reach where b in (select a from reach where a = b))",
    "depth as (select node, 0 as level from nodes where node not in (select child from links) "
    "union select l.child, d.level + 1 from depth d join links l on l.parent = d.node "
    "where l.child not in (select node from stuck))", recursive=True))
def dependency_levels(spark, sf_dir):
    return graph.dependency_levels(table(spark, sf_dir, "edges"))


PROJECTED = """select o_custkey::integer as customer_id, o_orderkey as id, substr(o_orderstatus, 1, 1) as o_orderstatus,
    o_totalprice::decimal(12,2)::varchar as total, o_orderdate::date::varchar as ordered_on,
    substr(o_orderpriority, 1, 4) as priority from """


def projected(spark, sf_dir, name):
    return project(table(spark, sf_dir, name), ORDER_MAPPINGS)


def read_back(spark, path):
    return spark.read.parquet(path).withColumn("total", F.col("total").cast("string")).withColumn(
        "ordered_on", F.col("ordered_on").cast("string"))


@query("load_truncate", PROJECTED + "orders")
def load_truncate(spark, sf_dir):
    path = scratch_path(spark, "load")
    load.load(projected(spark, sf_dir, "orders_dst"), path, "truncate")
    load.load(projected(spark, sf_dir, "orders"), path, "truncate")
    return read_back(spark, path)


@query("load_append", duck(PROJECTED + "{orders_dst} union all " + PROJECTED + "{orders}"))
def load_append(spark, sf_dir):
    path = scratch_path(spark, "load")
    load.load(projected(spark, sf_dir, "orders_dst"), path, "truncate")
    load.load(projected(spark, sf_dir, "orders"), path, "append")
    return read_back(spark, path)


@query("load_abort", "select error, (select count(*) from orders) as rows from (select 'conflict_mode=abort but public.orders has ' "
       "|| format('{:,}', count(*)) || ' rows' as error from orders) t")
def load_abort(spark, sf_dir):
    path = scratch_path(spark, "load")
    load.load(projected(spark, sf_dir, "orders"), path, "abort", "public.orders")
    try:
        load.load(projected(spark, sf_dir, "orders"), path, "abort", "public.orders")
        error = None
    except RuntimeError as e:
        error = str(e)
    return spark.read.parquet(path).agg(F.lit(error).alias("error"), F.count("*").alias("rows"))


SET = ("orders", "lineitem", "customer", "events")


@query("truncate_all", duck(" union all ".join(
    f"select '{n}' as table_name, count(*) as rows_written, count(*) as rows_read_back from {{{n}}}" for n in SET)))
def truncate_all(spark, sf_dir):
    """A set of destinations with old rows, replaced together."""
    base = scratch_path(spark, "set")
    for n in SET:
        old = table(spark, sf_dir, n)
        old.unionByName(old).write.parquet(f"{base}/{n}")
    written = load.truncate_all([(project(table(spark, sf_dir, n), identity(n)), f"{base}/{n}") for n in SET])
    return union_all([
        spark.read.parquet(f"{base}/{n}").agg(
            F.lit(n).alias("table_name"), F.lit(w).cast("bigint").alias("rows_written"), F.count("*").alias("rows_read_back"))
        for n, w in zip(SET, written)])


@query("load_atomic", duck(" union all ".join(
    f"select '{n}' as table_name, '{when}' as seen, count(*) as rows, sum({k}) as keys from {{{d}}}"
    for n, k, old in (("orders", "o_orderkey", "orders_dst"), ("customer", "c_custkey", "customer_dst"))
    for when, d in (("during", old), ("after failure", old), ("after", n)))))
def load_atomic(spark, sf_dir):
    """What readers see of two tables that are replaced together: between the moves, after a set that failed, and at the end."""
    base, seen = scratch_path(spark, "atomic"), []
    names = {"orders": ("o_orderkey", "orders_dst"), "customer": ("c_custkey", "customer_dst")}
    for n, (_, old) in names.items():
        load.load(table(spark, sf_dir, old), f"{base}/{n}", "truncate")

    def look(when):
        for n, (k, _) in names.items():
            rows = load.read_dest(spark, f"{base}/{n}", table(spark, sf_dir, n).schema)
            seen.append((n, when, *rows.agg(F.count("*"), F.sum(k)).first()))

    staged = {f"{base}/{n}": storage.stage(table(spark, sf_dir, n), f"{base}/{n}") for n in names}
    with storage.watched_moves(lambda done: look("during") if done == 3 else None):
        storage.publish(spark, staged)
    after = [(n, "after", *load.read_dest(spark, f"{base}/{n}", table(spark, sf_dir, n).schema).agg(F.count("*"), F.sum(k)).first())
             for n, (k, _) in names.items()]
    for n, (_, old) in names.items():
        load.load(table(spark, sf_dir, old), f"{base}/{n}", "truncate")
    bad = table(spark, sf_dir, "customer").withColumn("c_name", F.raise_error(F.lit("lost")))
    try:
        load.truncate_all([(table(spark, sf_dir, "orders"), f"{base}/orders"), (bad, f"{base}/customer")])
    except Exception:
        look("after failure")
    return spark.createDataFrame(seen + after, "table_name string, seen string, rows bigint, keys bigint")


@query("load_metrics", duck(" union all ".join(
    f"select 'public.{n}' as dest_table, count(*) as rows_read, count(*) as rows_written from {{{n}}}"
    for n in ("orders_dst", "lineitem", "documents", "supplier_dst"))))
def load_metrics(spark, sf_dir):
    rows = []
    for n in ("orders_dst", "lineitem", "documents", "supplier_dst"):
        done = load.load(table(spark, sf_dir, n), scratch_path(spark, n), "truncate", f"public.{n}")
        rows.append((done.dest_table, done.rows_read, done.rows_written))
    return spark.createDataFrame(rows, "dest_table string, rows_read bigint, rows_written bigint")


MOVED = {"region": "truncate", "nation": "truncate", "customer": "append", "orders": "truncate", "lineitem": "append",
         "supplier": "abort", "part": "abort"}

def sql_run_table(name, mode):
    if name == "part":
        return (f"select 'public.{name}' as source_table, '{mode}' as conflict_mode, 'failed' as status, null as rows_read, "
                "null as rows_written, null as checks, 'conflict_mode=abort but public.part has ' || format('{:,}', n) || ' rows' "
                f"as error from (select count(*) as n from {{{name}}}) t")
    if name == "customer":
        return (f"select 'public.{name}' as source_table, '{mode}' as conflict_mode, "
                "case when k > 100 then 'failed' else 'succeeded' end as status, n as rows_read, n as rows_written, "
                "'row_count, hash_sample, sequence_parity' as checks, case when k > 100 then 'row_count: MISMATCH: source=' || "
                "format('{:,}', n) || ' dest=' || format('{:,}', n + k) || ' (delta +' || format('{:,}', k) || ', exceeds ±100 "
                f"tolerance)' end as error from (select count(*) as n, (select count(*) from {{customer_dst}}) as k from {{{name}}}) t")
    return (f"select 'public.{name}' as source_table, '{mode}' as conflict_mode, 'succeeded' as status, n as rows_read, "
            f"n as rows_written, 'row_count, hash_sample, sequence_parity' as checks, null as error from "
            f"(select count(*) as n from {{{name}}}) t")


@query("run_migration", duck(" union all ".join(sql_run_table(n, mode) for n, mode in MOVED.items())))
def migration(spark, sf_dir):
    """Seven tables in three modes: customer is appended to old rows, part aborts on a filled destination."""
    base = scratch_path(spark, "run")
    table(spark, sf_dir, "customer_dst").withColumn("c_custkey", F.col("c_custkey") + 10_000_000).write.parquet(f"{base}/customer")
    table(spark, sf_dir, "part").write.parquet(f"{base}/part")
    table(spark, sf_dir, "orders_dst").write.parquet(f"{base}/orders")
    mappings = union_all([
        local_rows(spark, [(f"public.{n}", f"public.{n}", r["source_column"], r["dest_column"], r["source_type"],
                            r["default_dest_type"], r["override_dest_type"], "") for r in identity(n)],
                   strings("source_table", "dest_table", "source_column", "dest_column", "source_type", "default_dest_type",
                           "override_dest_type", "skip")) for n in MOVED])
    plan = included(local_rows(
        spark, [(f"public.{n}", f"public.{n}", mode, None) for n, mode in MOVED.items()],
        strings("source_table", "dest_table", "conflict_mode", "verification")).withColumn("include", F.lit(True)))
    mappings = mappings.withColumn("skip", F.lit(False))
    moves = [
        TableMove(p["source_table"], p["dest_table"], table(spark, sf_dir, n), f"{base}/{n}", None, p["conflict_mode"],
                  p["verification"], tuple(KEYS[n]),
                  sequences=(("o_orderkey", "orders_seq"),) if n == "orders" else (),
                  source_path=f"{sf_dir}/{n}.parquet")
        for p in plan.collect() for n in [p["source_table"].split(".")[1]]]
    edges = local_rows(spark, [("public.nation", "public.region"), ("public.customer", "public.nation"),
                               ("public.orders", "public.customer"), ("public.lineitem", "public.orders"),
                               ("public.supplier", "public.nation")], strings("child", "parent"))
    _, run_tables, _ = run_migration(moves, edges, mappings=mappings)
    return run_tables.select(
        "source_table", "conflict_mode", "status", "rows_read", "rows_written",
        F.nullif(F.array_join(F.transform("verification", lambda v: v["name"]), ", "), F.lit("")).alias("checks"), "error")
