"""Verification, row differences and audits, with hot keys and edge cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators import audit, rowdiff, sampling, verify
from tidemark.operators.audit import ForeignKey
from tidemark.operators.keyed import frequent_keys, lookup_join, tally
from tidemark.operators.marks import high_water_marks
from tidemark.operators.sampling import Sampled
from tidemark.operators.verify import TablePair
from tidemark.plans.verification import run_checks, verification_run


@pytest.fixture
def no_broadcast(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_levels(spark):
    empty = spark.range(0)

    def checks(level):
        return TablePair("a", "b", empty, empty, level=level).checks()

    assert checks("count_only") == ["row_count", "sequence_parity"]
    assert checks("count_and_sample") == ["row_count", "hash_sample", "sequence_parity"]
    assert checks("count_sample_and_full_hash") == ["row_count", "hash_sample", "full_hash", "sequence_parity"]
    assert checks(None) == checks("nonsense") == checks("count_and_sample")


@pytest.mark.parametrize("source, dest, passed, text", [
    (0, 0, True, "source=0 dest=0 (exact match)"),
    (100, 0, True, "source=100 dest=0 (delta -100, within ±100 tolerance"),
    (101, 0, False, "MISMATCH: source=101 dest=0 (delta -101, exceeds ±100 tolerance)"),
    (1_000_000, 1_001_000, True, "source=1,000,000 dest=1,001,000 (delta +1,000, within ±1,000 tolerance"),
    (1_000_000, 998_999, False, "MISMATCH: source=1,000,000 dest=998,999 (delta -1,001, exceeds ±1,000 tolerance)"),
])
def test_count_verdict(spark, source, dest, passed, text):
    verdict = verify.count_columns(F.lit(source).cast("bigint"), F.lit(dest).cast("bigint"))
    row = spark.range(1).select(verdict["passed"].alias("p"), verdict["detail"].alias("d")).collect()[0]
    assert row["p"] is passed and row["d"].startswith(text)


def test_sample_is_repeatable_and_inside_the_table(spark, table):
    orders = table("orders")
    first = {r["o_orderkey"]: r["row_hash"] for r in verify.sample_keys(orders, ["o_orderkey"]).collect()}
    again = {r["o_orderkey"]: r["row_hash"] for r in verify.sample_keys(orders.repartition(7), ["o_orderkey"]).collect()}
    other = {r["o_orderkey"] for r in verify.sample_keys(orders, ["o_orderkey"], seed="1").collect()}
    everything = {r["o_orderkey"] for r in orders.select("o_orderkey").collect()}
    assert first == again and set(first) <= everything and len(first) == 100 and set(first) != other


def test_composite_key_sample(spark, table):
    row = verify.hash_sample([TablePair("a", "b", table("conversations"), table("conversations_dst"), ("conv_id", "turn"))]).collect()[0]
    assert row["sample_size"] == 87 and row["missing_count"] > 0 and row["missing"][0].startswith("(")


def test_row_diff_with_itself_is_all_match(spark, table):
    for name, key in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("embeddings", ["vec_id"])):
        df = table(name)
        assert {r["status"] for r in rowdiff.row_diff(df, df.repartition(5), key).select("status").distinct().collect()} == {"match"}


def test_row_diff_against_brute_force_with_a_hot_key(spark):
    def rows(n, shift):
        return [(1 if i % 3 == 0 else i, (i * 7 + shift * (i % 11 == 0)) % 13, None if i % 5 == 0 else f"v{i % 4}") for i in range(n)]

    left, right = rows(900, 0), rows(880, 1)
    schema = "k int, a int, b string"
    got = {r["k"]: r["status"] for r in rowdiff.row_diff(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]).collect()}
    want = {}
    for k in {r[0] for r in left + right}:
        a, b = (Counter(r[1:] for r in side if r[0] == k) for side in (left, right))
        want[k] = "missing_in_dest" if not b else "missing_in_source" if not a else "match" if a == b else "mismatched"
    assert got == want and set(want.values()) == {"match", "mismatched", "missing_in_dest"}


def test_row_diff_is_one_shuffle_without_a_join(spark, table):
    diff = rowdiff.row_diff(table("orders"), table("orders_dst"), ["o_orderkey"])
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_column_changes_need_the_same_columns(spark, table):
    with pytest.raises(ValueError, match="not on both sides"):
        rowdiff.row_diff(table("orders"), table("customer"), ["o_orderkey"])


def test_failed_check_is_a_result(spark, table):
    broken = table("orders").withColumn("o_totalprice", F.raise_error(F.lit("disk lost")).cast("double"))
    good = TablePair("public.part", "public.part", table("part"), table("part"), ("p_partkey",))
    bad = TablePair("public.orders", "public.orders", table("orders"), broken, ("o_orderkey",))
    results, verdicts, status = verification_run([good, bad])
    found = {(r["source_table"], r["name"]): r for r in results.collect()}
    assert found["public.part", "hash_sample"]["passed"] and found["public.orders", "row_count"]["passed"]
    raised = found["public.orders", "hash_sample"]
    assert not raised["passed"] and raised["detail"] == fixed.CHECK_RAISED and "disk lost" in raised["error"]
    assert status == "failed"
    assert {r["source_table"]: r["status"] for r in verdicts.collect()} == {"public.part": "passed", "public.orders": "failed"}
    with pytest.raises(ValueError, match="No tables selected"):
        verification_run([])


def test_metrics_of_results(spark, table):
    rows = {r["name"]: r["metrics"] for r in run_checks([TablePair("a", "b", table("part"), table("part"), ("p_partkey",))]).collect()}
    assert rows["row_count"] == {"source": "200", "dest": "200", "delta": "0", "tolerance": "100", "exact_match": "true"}
    assert rows["hash_sample"]["sample_size"] == "100" and rows["hash_sample"]["missing"] == "[]"


def test_marks_never_move_back(spark):
    marks = spark.createDataFrame([("t", "a", 50), ("t", "b", 1), ("e", "a", 9)], "table_name string, column_name string, last_value bigint")
    data = spark.createDataFrame([(10, 20)], "a int, b int")
    got = {(r[0], r[1]): r[2] for r in high_water_marks({"t": (data, ["a", "b"]), "e": (data.limit(0), ["a"])}, marks).collect()}
    assert got == {("t", "a"): 50, ("t", "b"): 20, ("e", "a"): 9}


def test_orphans_with_nulls_and_a_hot_parent(spark):
    child = spark.range(3000).selectExpr("if(id % 3 = 0, 5, if(id % 7 = 0, null, id)) as ref")
    parent = spark.range(0, 2000).union(spark.range(0, 10)).toDF("id").filter("id <> 11")
    want = sum(1 for i in range(3000) if i % 3 and i % 7 and (i >= 2000 or i == 11))
    fk = ForeignKey("public.c", child, "ref", "public.p", parent, "id")
    assert audit.orphan_rows([fk]).collect()[0]["orphan_rows"] == want
    message = audit.orphan_findings(audit.orphan_rows([fk])).collect()[0]["message"]
    assert message.startswith(f"Source table public.c has {want:,} orphan row(s) — column ref references public.p.id")


def test_keys_with_nulls_never_clash(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 2), (2, 2), (2, 3)], "a int, b int")
    assert [tuple(r) for r in audit.duplicate_keys(df, ["a", "b"]).collect()] == [(2, 2, 2)]
    assert audit.pk_collisions(df, df, ["a", "b"]).count() == 2


def test_plan_findings_stop_at_the_first_missing_table(spark):
    plan = spark.createDataFrame([("gone", "public.d", "abort"), ("public.s", "nowhere", "append"), ("s", "public.d", "abort"),
                                  ("public.s", "public.d", "truncate"), ("public.s", "public.e", "truncate")],
                                 "source_table string, dest_table string, conflict_mode string")
    src = spark.createDataFrame([("public.s", 5)], "qn string, row_count bigint")
    dst = spark.createDataFrame([("public.d", 1200), ("public.e", 0)], "qn string, row_count bigint")
    mappings = spark.createDataFrame([("public.s", "public.d", False), ("public.s", "public.e", True)],
                                     "source_table string, dest_table string, skip boolean")
    found = audit.preflight(plan, src, dst, mappings)
    got = sorted((r["severity"], r["code"].split(".")[1], r["target"]) for r in found.collect())
    assert got == [
        ("error", "dest_not_empty", "table:public.d"), ("error", "dest_table_missing", "table:nowhere"),
        ("error", "no_mapped_columns", "table:gone"), ("error", "no_mapped_columns", "table:public.s"),
        ("error", "no_mapped_columns", "table:public.s"), ("error", "no_mapped_columns", "table:s"),
        ("error", "source_table_missing", "table:gone"), ("warning", "will_truncate", "table:public.d")]
    assert not audit.can_run(found).collect()[0]["can_run"]
    assert audit.can_run(found.filter("severity <> 'error'")).collect()[0]["can_run"]
    assert [r["code"] for r in audit.no_tables(plan.limit(0)).collect()] == ["preflight.no_tables"]
    assert audit.finding_rollup(found).first()["code"] == "preflight.no_mapped_columns"


def test_lookup_join_salts_only_hot_keys(spark, no_broadcast):
    rows = spark.range(30000).selectExpr("id", "if(id % 3 = 0, 42, id) as k")
    lookup = spark.range(0, 30000, 2).selectExpr("id as k", "id * 2 as v")
    for how, want in (("left", 30000), ("inner", 20000), ("left_anti", 10000), ("left_semi", 20000)):
        assert lookup_join(rows, lookup, ["k"], how).count() == want
    joined = lookup_join(rows, lookup, ["k"])
    assert joined.filter("k = 42 and v = 84").count() == 10000
    parts = joined.withColumn("p", F.spark_partition_id()).filter("k = 42").groupBy("p").count().collect()
    assert len(parts) > 1


def test_tally_counts_each_side(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (2,)], "k int")
    assert {(r["k"], r["a"], r["b"]) for r in tally(["k"], {"a": a, "b": b}).collect()} == {(1, 2, 1), (2, 0, 1), (None, 1, 0)}


def test_preflight_scans_every_key_of_planned_tables(spark):
    plan = spark.createDataFrame([("public.c", "public.c", "append"), ("public.s", "public.s", "append")],
                                 "source_table string, dest_table string, conflict_mode string")
    sizes = spark.createDataFrame([("public.c", 10), ("public.s", 2), ("public.p", 1)], "qn string, row_count bigint")
    mappings = spark.createDataFrame([("public.c", "public.c", False), ("public.s", "public.s", False)],
                                     "source_table string, dest_table string, skip boolean")
    parent = spark.range(1)
    keys = [ForeignKey(f"public.{n}", spark.range(size), "id", "public.p", parent, "id") for n, size in (("c", 10), ("s", 2), ("other", 9))]
    got = {r["target"]: r["message"] for r in audit.preflight(plan, sizes, sizes, mappings, keys).collect() if r["code"] == "preflight.orphan_rows"}
    assert set(got) == {"table:public.c", "table:public.s"} and "has 9 orphan row(s)" in got["table:public.c"]


def widest_share(df, column="part"):
    """Rows of the fullest task over the mean of the tasks."""
    sizes = [r["count"] for r in df.groupBy(column).count().collect()]
    return max(sizes) / (sum(sizes) / len(sizes))


def test_lookups_split_many_hot_keys_and_equal_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = spark.range(2000).selectExpr("id as k", "id * 2 as w")
        fifty = spark.range(50_000).selectExpr("id % 50 as k", "id as v")
        equal = spark.range(100_000).selectExpr("cast(7 as bigint) as k", "cast(1 as bigint) as v")
        for rows, most in ((fifty, 2), (equal, 4)):
            joined = lookup_join(rows, lookup, ["k"])
            assert joined.count() == rows.count() and joined.filter("w <> 2 * k or w is null").count() == 0
            assert widest_share(joined.withColumn("part", F.spark_partition_id())) < most
        nulls = spark.createDataFrame([(None, 1), (None, 1), (5, 2), (99999, 3)], "k bigint, v int")
        got = lookup_join(nulls, lookup, ["k"]).collect()
        assert sorted((str(r["k"]), r["v"], str(r["w"])) for r in got) == [
            ("5", 2, "10"), ("99999", 3, "None"), ("None", 1, "None"), ("None", 1, "None")]
        assert [tuple(r) for r in lookup_join(nulls, lookup, ["k"], "inner").collect()] == [(5, 2, 10)]
    finally:
        for name in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_samples_of_all_pairs_without_a_top_n(spark, table):
    pairs = [TablePair(n, n, table(n), table(d), k) for n, d, k in (
        ("orders", "orders_dst", ("o_orderkey",)), ("part", "part", ("p_partkey",)), ("lineitem", "lineitem", ()))]
    plan = verify.verify(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "CartesianProduct" not in plan


def test_a_cut_that_is_too_low_is_made_good(spark, table, monkeypatch):
    orders = Sampled(3, table("orders"), ("o_orderkey",), ("o_custkey",))
    part = Sampled(5, table("part"), ("p_partkey",), ("p_size",))
    rows = lambda df: sorted(map(tuple, df.collect()))
    right = rows(sampling.samples([orders, part]))
    passes = []
    inner = sampling.smallest
    monkeypatch.setattr(sampling, "smallest", lambda *a: passes.append(1) or inner(*a))
    assert rows(sampling.samples([orders, part])) == right and len(passes) == 1
    assert rows(sampling.samples([orders, part], cuts={3: "000", 5: None})) == right and len(passes) == 3
    assert [r[5] for r in right if r[0] == 3] and {r[0] for r in right} == {3, 5}


def test_bottom_k_against_sorting(spark):
    rows = [(p, f"{(i * 7919) % 5000:05d}", "k", f"m{i % 50}", f"h{i % 3}") for p in (1, 2) for i in range(4000)] * 2
    df = spark.createDataFrame(rows, "pair long, place string, key string, match string, row_hash string").repartition(9)
    got = sorted((r.pair, r.rn, r.place, r.match) for r in sampling.smallest(df, 1000).collect())
    want = [(p, n + 1, r[1], r[3]) for p in (1, 2) for n, r in enumerate(
        sorted({x for x in rows if x[0] == p}, key=lambda r: (r[1], r[3], r[4]))[:1000])]
    assert got == want


def test_sample_of_a_key_with_many_rows(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as k", "id % 5 as v")
    result = verify.hash_sample([TablePair("a", "b", rows, rows.selectExpr("cast(k as decimal(20,2)) as k", "v"), ("k",))]).collect()[0]
    assert result["missing_count"] == 0 and 0 < result["sample_size"] <= 100


def test_metrics_of_tables_without_key_or_rows(spark, table):
    none = table("part").filter("p_size < 0")
    pairs = [TablePair("a", "b", none, table("part"), ("p_partkey",)), TablePair("c", "d", table("part"), table("part"))]
    found = {r["source_table"]: r["metrics"] for r in run_checks(pairs).collect() if r["name"] == "hash_sample"}
    assert found == {"a": {"sample_size": "0", "checked": "0"}, "c": {"skipped": "true"}}


def test_ranges_find_what_row_diff_finds(spark, table):
    orders = table("orders")
    changed = orders.withColumn("o_totalprice", F.expr("if(o_orderkey in (3, 77), 1, o_totalprice)")).filter("o_orderkey <> 50")
    other_type = changed.withColumn("o_orderkey", F.col("o_orderkey").cast("decimal(20,0)"))
    twice = orders.unionByName(orders.filter("o_orderkey = 9"))
    for dest in (changed, other_type, orders, twice, orders.limit(0)):
        want = sorted(map(tuple, rowdiff.row_diff(orders, dest, ["o_orderkey"]).filter("status <> 'match'").collect()))
        got = sorted(map(tuple, rowdiff.row_diff_ranges(orders, dest, ["o_orderkey"]).collect()))
        assert got == want
    assert rowdiff.row_diff_ranges(orders.limit(0), orders.limit(0), ["o_orderkey"]).collect() == []


def test_rows_of_equal_ranges_are_not_shuffled(spark, table):
    lines = table("lineitem")
    dest = lines.withColumn("l_quantity", F.expr("if(l_orderkey = 7, -1, l_quantity)"))
    diff = rowdiff.row_diff_ranges(lines, dest, ["l_orderkey", "l_linenumber"])
    found = diff.collect()
    assert {r["l_orderkey"] for r in found} == {7}
    plan = diff._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in text

    # rows that went through the one exchange on the key
    rows, stack = [], [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                rows.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    total = lines.count()
    assert rows and max(rows) < total / 20


def test_frequent_keys_come_from_sketches(spark):
    """Every key above the share is found, whatever the others are; near ones may be; no key is shuffled."""
    n, parts = 120_000, 8
    rows = spark.range(0, n, 1, 12).selectExpr(
        "case when id % 3 = 0 then 'a' when id % 5 = 0 then 'b' when id % 30 = 1 then null else concat('k', id) end as k")
    named = {r.h: r.k for r in rows.filter("k in ('a', 'b') or k is null").selectExpr("k", "xxhash64(k) as h").distinct().collect()}
    found = {named.get(h, "other") for h in frequent_keys(rows, ["k"], parts)}
    assert {"a", "b"} <= found <= {"a", "b", None}
    assert frequent_keys(rows.limit(0), ["k"]) == [] and frequent_keys(spark.range(50_000), ["id"]) == []
    assert len(frequent_keys(spark.range(9).selectExpr("id % 2 as k"), ["k"], 4)) == 2
