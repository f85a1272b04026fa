"""Verification queries: counts, samples, digests, row differences, sequences."""

from pyspark.sql import functions as F

from tidemark.functions.canon import row_hash
from tidemark.functions.text import mask_credentials, name_of, schema_of, signed_thousands, thousands, with_schema
from tidemark.operators import marks as hwm
from tidemark.operators import rowdiff, sampling, verify
from tidemark.operators.keyed import union_all
from tidemark.operators.verify import TablePair
from tidemark.plans.verification import verification_run
from workloads.derived import GIVEN, KEYS, duck, table
from workloads.registry import query

COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "num", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "num"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int",
             "p_retailprice": "num"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "num",
               "o_orderdate": "ts", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "num",
                 "l_extendedprice": "num", "l_discount": "num", "l_tax": "num", "l_returnflag": "text",
                 "l_linestatus": "text", "l_shipdate": "ts"},
    "events": {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "text", "value": "num", "props": "text"},
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "embeddings": {"vec_id": "int", "embedding": "floats", "label": "int"},
    "pages": {"page_id": "int", "url": "text", "html": "text"},
    "benchmark": {"item_id": "int", "text": "text"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}


def sql_cell(name: str, kind: str) -> str:
    if kind == "text":
        return f"coalesce(cast(length({name}) as varchar) || ':' || {name}, '\\N')"
    if kind == "floats":
        item = "cast(cast(cast(x as double) * 1152921504606846976.0 as bigint) as varchar)"
        return f"coalesce('[' || array_to_string(list_transform({name}, lambda x: {item}), chr(30)) || ']', '\\N')"
    if kind == "num":
        single = f"{name} = cast(cast({name} as float) as double) and ({name} = 0 or (abs({name}) >= 1.4551915228366852e-11 and abs({name}) < 4))"
        return (f"coalesce(case when {single} then cast(cast({name} * 1152921504606846976.0 as bigint) as varchar) "
                f"else cast({name} as varchar) end, '\\N')")
    return f"coalesce(cast({name} as varchar), '\\N')"


def sql_hash(given: str) -> str:
    cells = [sql_cell(n, k) for n, k in sorted(COLUMNS[given].items())]
    return f"md5({' || chr(31) || '.join(cells)})"


def sql_halves(hash_column: str = "h") -> tuple[str, str]:
    return tuple(
        f"cast(coalesce(sum(cast('0x' || substr({hash_column}, {start}, 15) as bigint)), 0) as varchar)" for start in (1, 16))


def sql_totals(source: str, dest: str) -> str:
    return f"(select count(*) from {source}) as source, (select count(*) from {dest}) as dest"


SQL_COUNT_CHECK = """
    select source_table, source, dest, dest - source as delta, tolerance, dest = source as exact_match,
           abs(dest - source) <= tolerance as passed,
           case when dest = source then format('source={:,} dest={:,} (exact match)', source, dest)
                when abs(dest - source) <= tolerance then
                  format('source={:,} dest={:,} (delta ', source, dest) || case when dest >= source then '+' else '' end ||
                  format('{:,}, within ±{:,} tolerance — likely live-source churn during the migration window)',
                         dest - source, tolerance)
                else
                  format('MISMATCH: source={:,} dest={:,} (delta ', source, dest) ||
                  case when dest >= source then '+' else '' end ||
                  format('{:,}, exceeds ±{:,} tolerance)', dest - source, tolerance) end as detail
    from (select *, greatest(100, cast(floor(source * 0.001::double) as bigint)) as tolerance from counts) c"""

CHANGED = {"orders": "orders_dst", "customer": "customer_dst", "supplier": "supplier_dst",
           "conversations": "conversations_dst"}
SEQUENCES = {
    "orders": (("o_orderkey", "orders_o_orderkey_seq"),), "customer": (("c_custkey", "customer_c_custkey_seq"),),
    "supplier": (("s_suppkey", "supplier_s_suppkey_seq"),),
    "part": (("p_partkey", "part_p_partkey_seq"), ("p_size", "part_p_size_seq")),
}


def pair(spark, sf_dir, name, level=None, sequences=(), dest=None) -> TablePair:
    other = dest or CHANGED.get(name, name)
    return TablePair(f"public.{name}", f"public.{name}", table(spark, sf_dir, name), table(spark, sf_dir, other),
                     tuple(KEYS[name]), None, sequences, level)


def counts_sql(names) -> str:
    rows = " union all ".join(
        f"select 'public.{n}' as source_table, {sql_totals('{' + n + '}', '{' + CHANGED.get(n, n) + '}')}" for n in names)
    return f"counts as ({rows})"


@query("row_count", duck(SQL_COUNT_CHECK, counts_sql(GIVEN)))
def row_count(spark, sf_dir):
    pairs = [pair(spark, sf_dir, n) for n in GIVEN]
    return verify.row_count(pairs).drop("dest_table")


@query("row_count_strict", duck(
    "select source_table, dest - source as delta, source = dest as passed from counts", counts_sql(GIVEN)))
def row_count_strict(spark, sf_dir):
    pairs = [pair(spark, sf_dir, n) for n in GIVEN]
    return verify.row_count(pairs, strict=True).select("source_table", "delta", "passed")


@query("count_detail_text", duck(
    f"select source_table as o_orderkey, passed, detail from ({SQL_COUNT_CHECK}) t",
    "counts as (select o_orderkey as source_table, cast(round(o_totalprice) as bigint) as source, "
    "cast(round(o_totalprice) as bigint) + o_custkey - 700 as dest from {orders})"))
def count_detail_text(spark, sf_dir):
    numbers = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round("o_totalprice").cast("bigint").alias("source"),
        (F.round("o_totalprice").cast("bigint") + F.col("o_custkey") - 700).alias("dest"))
    verdict = verify.count_columns(F.col("source"), F.col("dest"))
    return numbers.select("o_orderkey", verdict["passed"].alias("passed"), verdict["detail"].alias("detail"))


SQL_SAMPLE_SIZE = "least(least(1000, greatest(100, cast(floor(n * 0.01::double) as bigint))), n)"


@query("sample_size", f"select n, cast({SQL_SAMPLE_SIZE} as bigint) as sample_size "
       "from (select cast(floor(o_totalprice) as bigint) as n from orders) t")
def sample_size(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.floor("o_totalprice").cast("bigint").alias("n"))
    return n.select("n", sampling.sample_size(F.col("n")).alias("sample_size"))


def sql_sample(name: str) -> str:
    key = KEYS[name][0]
    return (
        f"sample as (select k, h, rn from (select {key} as k, {sql_hash(name)} as h, "
        f"row_number() over (order by md5(cast({key} as varchar) || '0'), {key}) as rn from {{{name}}}) t "
        f"where rn <= (select {SQL_SAMPLE_SIZE} from (select count(*) as n from {{{name}}}) c))")


@query("sample_keys", duck("select k as o_orderkey, rn, h as row_hash from sample", sql_sample("orders")))
def sample_keys(spark, sf_dir):
    return verify.sample_keys(table(spark, sf_dir, "orders"), ["o_orderkey"])


def sql_hash_sample(name: str) -> str:
    key = KEYS[name][0]
    other = CHANGED.get(name, name)
    return duck(
        f"""select 'public.{name}' as source_table, missing_count = 0 and mismatched_count = 0 as passed,
              case when sample_size = 0 then 'empty table — nothing to sample'
                   when missing_count = 0 and mismatched_count = 0 then sample_size || ' sampled rows match'
                   else 'MISMATCH: ' || case when missing_count > 0 then missing_count || ' missing on dest' else '' end ||
                     case when missing_count > 0 and mismatched_count > 0 then ', ' else '' end ||
                     case when mismatched_count > 0 then mismatched_count || ' content mismatches' else '' end ||
                     ' (sampled ' || sample_size || ')' end as detail,
              sample_size, missing_count, mismatched_count, missing, mismatched, '{key}' as pk_column
            from (select count(*) as sample_size, count(*) filter (d.h is null) as missing_count,
                    count(*) filter (d.h <> s.h) as mismatched_count,
                    coalesce(array_to_string(list_sort(list(cast(s.k as varchar)) filter (d.h is null)), ','), '')
                      as missing,
                    coalesce(array_to_string(list_sort(list(cast(s.k as varchar)) filter (d.h <> s.h)), ','), '')
                      as mismatched
                  from sample s left join dest d on d.k = s.k) t""",
        sql_sample(name), f"dest as (select {key} as k, {sql_hash(name)} as h from {{{other}}})")


def flat_sample(df):
    return df.select(
        "source_table", "passed", "detail", "sample_size", "missing_count", "mismatched_count",
        F.array_join("missing", ",").alias("missing"), F.array_join("mismatched", ",").alias("mismatched"), "pk_column")


def _register_samples():
    for name in ("orders", "customer", "supplier", "events"):
        @query(f"hash_sample_{name}", sql_hash_sample(name))
        def build(spark, sf_dir, name=name):
            return flat_sample(verify.hash_sample([pair(spark, sf_dir, name)]))


_register_samples()


@query("hash_sample_edge_cases", duck("""
    select 'public.lineitem' as source_table, true as passed, 'skipped — no single-column PK to sample on' as detail,
           cast(null as bigint) as sample_size, true as skipped, cast(null as bigint) as checked
    union all select name, true, case when n = 0 then 'empty table — nothing to sample' else """ + f"{SQL_SAMPLE_SIZE}" + """ || ' sampled rows match' end,
           """ + f"{SQL_SAMPLE_SIZE}" + """, null, case when n = 0 then 0 end
    from (select 'public.supplier' as name, count(*) as n from {supplier} where s_acctbal > 1000000
          union all select 'public.nation', count(*) from {nation}
          union all select 'public.part', count(*) from {part} where p_size > 45) t"""))
def hash_sample_edge_cases(spark, sf_dir):
    """A table without a key, one that a filter leaves without rows, one smaller than the least sample, and one more."""
    def some(name, where="true"):
        df = table(spark, sf_dir, name).filter(where)
        return TablePair(f"public.{name}", f"public.{name}", df, df.repartition(3), tuple(KEYS[name]))
    pairs = [pair(spark, sf_dir, "lineitem"), some("supplier", "s_acctbal > 1000000"), some("nation"), some("part", "p_size > 45")]
    return verify.hash_sample(pairs).select("source_table", "passed", "detail", "sample_size", "skipped", "checked")


@query("row_hash", duck(" union all ".join(
    f"select '{n}' as table_name, {' || '.join(f'cast({k} as varchar)' for k in KEYS[n]) or 'null'} as row_key, "
    f"{sql_hash(n)} as row_hash from {{{n}}}" for n in GIVEN)))
def hashes(spark, sf_dir):
    parts = []
    for n in GIVEN:
        df = table(spark, sf_dir, n)
        row_key = F.concat(*[F.col(k).cast("string") for k in KEYS[n]]) if KEYS[n] else F.lit(None).cast("string")
        parts.append(df.select(
            F.lit(n).alias("table_name"), row_key.alias("row_key"),
            row_hash(df).alias("row_hash")))
    return union_all(parts)


# the same values in other types, but for one row in 97 whose prices are really different
SQL_OTHER_TYPES = """
    select cast(o_orderkey as decimal(20,0)) as o_orderkey, cast(o_custkey as decimal(12,2)) as o_custkey,
           cast(floor(o_totalprice) as decimal(14,3)) as whole, cast(floor(o_totalprice / 2) / 4 as float) as quarter,
           case when o_orderkey % 97 = 0 then -1.0 else -0.0 end as zero
    from {orders}"""


@query("row_diff_types", duck("""
    select o_orderkey, cast(1 as bigint) as source_rows, cast(1 as bigint) as dest_rows,
           case when o_orderkey % 97 = 0 or abs(floor(o_totalprice / 2) / 4) > 16777216 then 'mismatched' else 'match' end as status
    from {orders}"""))
def row_diff_types(spark, sf_dir):
    """Integers against decimals, decimals of other scales, doubles against floats, and both zeros."""
    orders = table(spark, sf_dir, "orders")
    source = orders.selectExpr(
        "cast(o_orderkey as decimal(20,0)) as o_orderkey", "o_custkey", "cast(floor(o_totalprice) as bigint) as whole",
        "floor(o_totalprice / 2) / 4D as quarter", "cast(0 as double) as zero")
    dest = spark.sql(SQL_OTHER_TYPES, orders=orders).withColumn("zero", F.col("zero").cast("double") * F.lit(-1.0).cast("double") * -1)
    return rowdiff.row_diff(source, dest, ["o_orderkey"]).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def sql_digests(names, changed=True) -> str:
    def one(n):
        other = CHANGED.get(n, n) if changed else n
        high, low = sql_halves()
        return (
            f"select 'public.{n}' as source_table, s.n as source, d.n as dest, s.high as source_high, s.low as source_low, "
            f"d.high as dest_high, d.low as dest_low, s.n = d.n and s.high = d.high and s.low = d.low as passed from "
            f"(select count(*) as n, {high} as high, {low} as low from (select {sql_hash(n)} as h from {{{n}}}) x) s, "
            f"(select count(*) as n, {high} as high, {low} as low from (select {sql_hash(n)} as h from {{{other}}}) x) d")
    return duck(" union all ".join(one(n) for n in names))


@query("full_hash", sql_digests(GIVEN))
def full_hash(spark, sf_dir):
    return verify.full_hash([pair(spark, sf_dir, n) for n in GIVEN]).drop("dest_table", "detail")


def sql_row_diff(name: str, other: str) -> str:
    keys = KEYS[name]
    on = " and ".join(f"s.{k} = d.{k}" for k in keys)
    names = ", ".join(f"coalesce(s.{k}, d.{k}) as {k}" for k in keys)
    cols = ", ".join(keys)
    return duck(
        f"select {names}, coalesce(s.n, 0) as source_rows, coalesce(d.n, 0) as dest_rows, "
        f"case when d.n is null then 'missing_in_dest' when s.n is null then 'missing_in_source' "
        f"when s.n = d.n and s.h = d.h then 'match' else 'mismatched' end as status from s full join d on {on}",
        f"s as (select {cols}, count(*) as n, min({sql_hash(name)}) as h from {{{name}}} group by {cols})",
        f"d as (select {cols}, count(*) as n, min({sql_hash(name)}) as h from {{{other}}} group by {cols})")


def _register_diffs():
    for name in ("orders", "conversations"):
        @query(f"row_diff_{name}", sql_row_diff(name, CHANGED[name]))
        def build(spark, sf_dir, name=name):
            return rowdiff.row_diff(table(spark, sf_dir, name), table(spark, sf_dir, CHANGED[name]), KEYS[name])


_register_diffs()


def _register_range_diffs():
    for name in ("orders", "conversations", "customer"):
        @query(f"row_diff_ranges_{name}", f"select * from ({sql_row_diff(name, CHANGED[name])}) r where status <> 'match'")
        def build(spark, sf_dir, name=name):
            return rowdiff.row_diff_ranges(table(spark, sf_dir, name), table(spark, sf_dir, CHANGED[name]), KEYS[name])


_register_range_diffs()


@query("row_diff_summary", duck("""
    select (select count(*) from {orders}) as source_rows, (select count(*) from {orders_dst}) as dest_rows,
           count(*) filter (status = 'match') as match, count(*) filter (status = 'mismatched') as mismatched,
           count(*) filter (status = 'missing_in_dest') as missing_in_dest,
           count(*) filter (status = 'missing_in_source') as missing_in_source
    from (select case when d.o_orderkey is null then 'missing_in_dest' when s.o_orderkey is null then 'missing_in_source'
                      when s.o_totalprice = d.o_totalprice then 'match' else 'mismatched' end as status
          from {orders} s full join {orders_dst} d on s.o_orderkey = d.o_orderkey) t"""))
def row_diff_summary(spark, sf_dir):
    diff = rowdiff.row_diff(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders_dst"), ["o_orderkey"])
    return rowdiff.row_diff_summary(diff)


@query("row_diff_repeated_keys", duck("""
    select coalesce(s.k, d.k) as l_orderkey, coalesce(s.n, 0) as source_rows, coalesce(d.n, 0) as dest_rows,
           case when d.n is null then 'missing_in_dest' when s.n is null then 'missing_in_source'
                when s.rows = d.rows then 'match' else 'mismatched' end as status
    from (select l_orderkey as k, count(*) as n, list_sort(list(""" + sql_hash("lineitem") + """)) as rows from {lineitem}
          group by 1) s
    full join (select l_orderkey as k, count(*) as n, list_sort(list(""" + sql_hash("lineitem") + """)) as rows
          from {lineitem} where l_linenumber <> 7 group by 1) d on s.k = d.k"""))
def row_diff_repeated_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rowdiff.row_diff(lines, lines.filter("l_linenumber <> 7"), ["l_orderkey"])


@query("column_changes", duck("""
    select column_name, count(*) filter (changed) as changed_keys from (
      select unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as column_name,
             unnest([s.o_custkey is distinct from d.o_custkey, s.o_orderstatus is distinct from d.o_orderstatus,
                     s.o_totalprice is distinct from d.o_totalprice, s.o_orderdate is distinct from d.o_orderdate,
                     s.o_orderpriority is distinct from d.o_orderpriority]) as changed
      from {orders} s join {orders_dst} d on s.o_orderkey = d.o_orderkey) t group by column_name"""))
def column_changes(spark, sf_dir):
    return rowdiff.column_changes(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders_dst"), ["o_orderkey"])


@query("high_water_marks", duck("""
    select table_name, column_name, max(last_value) as last_value from (
      select * from {marks} union all select 'public.orders', 'o_orderkey', max(o_orderkey) from {orders_dst}
      union all select 'public.customer', 'c_custkey', max(c_custkey) from {customer}
      union all select 'public.supplier', 's_suppkey', max(s_suppkey) from {supplier_dst}
      union all select 'public.part', 'p_partkey', max(p_partkey) from {part}
      union all select 'public.part', 'p_size', max(p_size) from {part}) t group by table_name, column_name"""))
def high_water_marks(spark, sf_dir):
    def t(n):
        return table(spark, sf_dir, n)

    return hwm.high_water_marks(
        {"public.orders": (t("orders_dst"), ["o_orderkey"]), "public.customer": (t("customer"), ["c_custkey"]),
         "public.supplier": (t("supplier_dst"), ["s_suppkey"]), "public.part": (t("part"), ["p_partkey", "p_size"])},
        t("marks"))


@query("mark_messages", duck("""
    select table_name, column_name, column_name || ': setval(' || sequence_name || ', ' || n || ')' as message from (
      select 'public.orders' as table_name, 'o_orderkey' as column_name, 'public.orders_seq' as sequence_name, max(o_orderkey) as n from {orders_dst}
      union all select 'public.orders', 'o_custkey', 'public.orders_cust_seq', max(o_custkey) from {orders_dst}
      union all select 'public.events', 'event_id', 'public.events_seq', max(event_id) from {events}
      union all select 'public.supplier', 's_suppkey', 'public.supplier_seq', max(s_suppkey) from {supplier_dst}) t where n is not null"""))
def mark_messages(spark, sf_dir):
    return hwm.mark_messages({
        "public.orders": (table(spark, sf_dir, "orders_dst"), [("o_orderkey", "public.orders_seq"), ("o_custkey", "public.orders_cust_seq")]),
        "public.events": (table(spark, sf_dir, "events"), [("event_id", "public.events_seq")]),
        "public.supplier": (table(spark, sf_dir, "supplier_dst"), [("s_suppkey", "public.supplier_seq")])})


SEQUENCE_NAMES = ("orders", "customer", "supplier", "part", "nation")
SQL_SEQUENCES = """
    select source_table, behind = 0 as passed,
           case when sequences = 0 then 'no sequence-backed columns'
                when behind = 0 then sequences || ' sequence(s) at or ahead of max(pk)'
                else 'BEHIND: ' || behind || ' sequence(s) behind their column max' end as detail, sequences, behind
    from (select m.source_table, count(m.column_name) as sequences,
                 count(*) filter (m.max_value is not null and coalesce(k.last_value < m.max_value, true)) as behind
          from maxima m left join {marks} k on k.table_name = m.source_table and k.column_name = m.column_name
          group by m.source_table) t"""


def sql_maxima(names) -> str:
    rows = [
        f"select 'public.{n}' as source_table, '{c}' as column_name, max({c}) as max_value from {{{CHANGED.get(n, n)}}}"
        for n in names for c, _ in SEQUENCES.get(n, ())]
    rows += [f"select 'public.{n}', null, null" for n in names if n not in SEQUENCES]
    return f"maxima as ({' union all '.join(rows)})"


@query("sequence_parity", duck(SQL_SEQUENCES, sql_maxima(SEQUENCE_NAMES)))
def sequence_parity(spark, sf_dir):
    pairs = [pair(spark, sf_dir, n, sequences=SEQUENCES.get(n, ())) for n in SEQUENCE_NAMES]
    return verify.sequence_parity(pairs, table(spark, sf_dir, "marks")).drop("dest_table")


@query("sequence_states", duck(" union all ".join(
    f"select 'public.{n}' as source_table, '{c}' as column_name, '{s}' as sequence_name, x.m as max_value, k.last_value, "
    f"x.m is null or coalesce(k.last_value >= x.m, false) as ok from (select max({c}) as m from {{{CHANGED.get(n, n)}}}) x "
    f"left join {{marks}} k on k.table_name = 'public.{n}' and k.column_name = '{c}'"
    for n in SEQUENCES for c, s in SEQUENCES[n])))
def sequence_states(spark, sf_dir):
    pairs = [pair(spark, sf_dir, n, sequences=SEQUENCES[n]) for n in SEQUENCES]
    return verify.sequence_states(pairs, table(spark, sf_dir, "marks")).drop("dest_table")


LEVELS = {"orders": "count_sample_and_full_hash", "customer": "count_and_sample", "supplier": "count_only",
          "part": None, "nation": "no such level"}


def verify_sql(columns: str) -> str:
    counts = duck(SQL_COUNT_CHECK, counts_sql(LEVELS))
    parts = [f"select source_table, 0 as position, 'row_count' as name, passed, detail from ({counts}) a"]
    for n in ("orders", "customer", "part", "nation"):
        parts.append(
            f"select source_table, 1 as position, 'hash_sample' as name, passed, detail from ({sql_hash_sample(n)}) s_{n}")
    parts.append(
        "select source_table, 2 as position, 'full_hash' as name, passed, case when passed then "
        "format('{:,} rows, digests match', source) else "
        "format('MISMATCH: digests differ (source={:,} dest={:,} rows)', source, dest) end as detail "
        f"from ({sql_digests(['orders'])}) f")
    parts.append(
        "select source_table, case source_table when 'public.orders' then 3 when 'public.supplier' then 1 else 2 end "
        f"as position, 'sequence_parity' as name, passed, detail from ({duck(SQL_SEQUENCES, sql_maxima(LEVELS))}) q")
    return f"select {columns} from ({' union all '.join(parts)}) r"


def verify_pairs(spark, sf_dir):
    return [pair(spark, sf_dir, n, level, SEQUENCES.get(n, ())) for n, level in LEVELS.items()]


@query("verify_levels", verify_sql("source_table, cast(position as bigint) as position, name, passed, detail"))
def verify_levels(spark, sf_dir):
    results = verify.verify(verify_pairs(spark, sf_dir), table(spark, sf_dir, "marks"))
    return results.select("source_table", "position", "name", "passed", "detail")


@query("verification_run", "select source_table, case when bool_and(passed) then 'passed' else 'failed' end as status, "
       "string_agg(name || ': ' || detail, '; ' order by position) filter (not passed) as error from ("
       + verify_sql("source_table, position, name, passed, detail") + ") v group by source_table")
def verification(spark, sf_dir):
    _, verdicts, _ = verification_run(verify_pairs(spark, sf_dir), table(spark, sf_dir, "marks"))
    return verdicts.drop("pair", "dest_table")


@query("mask_credentials", duck(
    "select page_id, regexp_replace(url, '://[^@/]+@', '://***@', 'g') as url from {urls}"))
def masked(spark, sf_dir):
    return table(spark, sf_dir, "urls").select("page_id", mask_credentials(F.col("url")).alias("url"))


@query("qualified_names", duck("""
    select name, case when position('.' in name) > 0 then split_part(name, '.', 1) else 'public' end as schema_name,
           case when position('.' in name) > 0 then substr(name, position('.' in name) + 1) else name end as table_name,
           case when position('.' in name) > 0 then name else 'public.' || name end as full_name
    from (select case p_partkey % 3 when 0 then p_type when 1 then p_type || '.' || p_name else p_type || '.a.' || p_brand end
            as name from {part}) t"""))
def qualified_names(spark, sf_dir):
    name = F.expr("case p_partkey % 3 when 0 then p_type when 1 then p_type || '.' || p_name "
                  "else p_type || '.a.' || p_brand end").alias("name")
    return table(spark, sf_dir, "part").select(name).select(
        "name", schema_of(F.col("name")).alias("schema_name"), name_of(F.col("name")).alias("table_name"),
        with_schema(F.col("name")).alias("full_name"))


@query("number_formats", """
    select event_id, format('{:,}', cast(floor(value * 100) as bigint)) as plain,
           case when event_id >= user_id * 100 then '+' else '' end || format('{:,}', event_id - user_id * 100) as signed
    from events""")
def number_formats(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", thousands(F.floor(F.col("value") * 100).cast("bigint")).alias("plain"),
        signed_thousands(F.col("event_id") - F.col("user_id") * 100).alias("signed"))


@query("flagship", duck("""
    select c.source, c.dest, c.delta, c.passed, d.match, d.mismatched, d.missing_in_dest, d.missing_in_source
    from (""" + SQL_COUNT_CHECK + """) c, (
      select count(*) filter (s.o_totalprice = d.o_totalprice) as match,
             count(*) filter (s.o_totalprice <> d.o_totalprice) as mismatched,
             count(*) filter (d.o_orderkey is null) as missing_in_dest,
             count(*) filter (s.o_orderkey is null) as missing_in_source
      from {orders} s full join {orders_dst} d on s.o_orderkey = d.o_orderkey) d""", counts_sql(["orders"])))
def flagship(spark, sf_dir):
    """Counts and row differences come from the same keyed pass."""
    diff = rowdiff.row_diff(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders_dst"), ["o_orderkey"])
    verdict = verify.count_columns(F.col("source_rows"), F.col("dest_rows"))
    return rowdiff.row_diff_summary(diff).select(
        F.col("source_rows").alias("source"), F.col("dest_rows").alias("dest"), verdict["delta"].alias("delta"),
        verdict["passed"].alias("passed"), "match", "mismatched", "missing_in_dest", "missing_in_source")
