"""Loads, migration runs, load order, run logs and the transition stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, load, runs
from tidemark.operators.verify import TablePair
from tidemark.plans.verification import verification_run
from tidemark.plans.migration import TableMove, included, load_waves, run_migration
from tidemark.sources import storage
from tidemark.sources.tables import scan, sink
from tidemark.streaming import transitions as streaming


def numbers(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id", "concat('v', id) as v")


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def leftovers(path):
    parent = os.path.dirname(path)
    return [n for n in os.listdir(parent) if any(m in n for m in (".staged-", ".replaced-", ".publish-", ".published-"))]


def test_conflict_modes(spark, tmp_path):
    dest = f"{tmp_path}/t"
    assert load.load(numbers(spark, 5), dest, "abort").rows_written == 5
    with pytest.raises(RuntimeError, match="conflict_mode=abort but public.t has 5 rows"):
        load.load(numbers(spark, 3), dest, "abort", "public.t")
    assert load.load(numbers(spark, 3, 100), dest, "append").rows_read == 3
    assert ids(spark, dest) == [0, 1, 2, 3, 4, 100, 101, 102]
    assert load.load(numbers(spark, 2, 7), dest, "truncate").rows_written == 2
    assert ids(spark, dest) == [7, 8] and leftovers(dest) == []
    load.load(numbers(spark, 0), dest, "truncate")
    assert load.load(numbers(spark, 1), dest, "abort").rows_written == 1
    with pytest.raises(ValueError, match="same"):
        load.load(numbers(spark, 1), dest, "truncate", source_path=f"file:{dest}")
    with pytest.raises(ValueError):
        load.load(numbers(spark, 1), dest, "merge")


def failing(spark):
    return numbers(spark, 100).withColumn("v", F.when(F.col("id") == 99, F.raise_error(F.lit("bad row"))).otherwise(F.col("v")))


@pytest.mark.parametrize("mode", ["truncate", "append"])
def test_failed_load_leaves_the_destination(spark, tmp_path, mode):
    dest = f"{tmp_path}/t"
    load.load(numbers(spark, 4), dest, "truncate")
    with pytest.raises(Exception, match="bad row"):
        load.load(failing(spark), dest, mode)
    assert ids(spark, dest) == [0, 1, 2, 3]


def test_truncate_set_is_all_or_nothing(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    assert load.truncate_all([(numbers(spark, 2), a), (numbers(spark, 3), b)]) == [2, 3]
    with pytest.raises(Exception, match="bad row"):
        load.truncate_all([(numbers(spark, 9), a), (failing(spark), b)])
    assert ids(spark, a) == [0, 1] and ids(spark, b) == [0, 1, 2] and leftovers(a) == []
    with pytest.raises(ValueError, match="twice"):
        load.truncate_all([(numbers(spark, 1), a), (numbers(spark, 1), a)])


def test_publish_moves_everything_back(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    load.truncate_all([(numbers(spark, 1), a), (numbers(spark, 2), b)])
    staged = storage.stage(numbers(spark, 5), a)
    with pytest.raises(Exception):
        storage.publish(spark, {a: staged, b: f"{tmp_path}/never-written"})
    assert ids(spark, a) == [0] and ids(spark, b) == [0, 1] and leftovers(a) == []
    with pytest.raises(ValueError):
        storage.discard(spark, a)


@pytest.mark.parametrize("moves", range(5))
def test_an_interrupted_publication_is_recovered(spark, tmp_path, monkeypatch, moves):
    """The driver dies after so many moves; the next reader sees old data everywhere, or new data everywhere."""
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    load.truncate_all([(numbers(spark, 1), a), (numbers(spark, 2), b)])
    staged = {a: storage.stage(numbers(spark, 5), a), b: storage.stage(numbers(spark, 6), b)}
    real, left = storage._move, [moves]

    class Died(BaseException):
        pass

    def dying(*args):
        if left[0] == 0:
            raise Died
        left[0] -= 1
        real(*args)

    monkeypatch.setattr(storage, "_move", dying)
    if moves == 4:  # all in place, not yet cleaned up
        monkeypatch.setattr(storage, "_finish", lambda *args: (_ for _ in ()).throw(Died()))
    with pytest.raises(Died):
        storage.publish(spark, staged)
    monkeypatch.undo()
    want = [6, 5] if moves == 4 else [2, 1]
    before = sorted(os.listdir(tmp_path))
    assert [load.read_dest(spark, p, "id bigint, v string").count() for p in (b, a)] == want
    assert sorted(os.listdir(tmp_path)) == before  # readers move nothing
    with pytest.raises(storage.PublicationBusy):
        storage.recover(spark, [b])  # its lease still runs
    monkeypatch.setattr(storage.time, "time", lambda: 4e9)
    storage.recover(spark, [b, a])
    assert [load.read_dest(spark, p, "id bigint, v string").count() for p in (b, a)] == want and leftovers(a) == []
    assert [len(ids(spark, p)) for p in (b, a)] == want


def test_readers_and_writers_in_the_middle_of_a_live_publication(spark, tmp_path):
    names = [f"{tmp_path}/{n}" for n in ("a", "b", "new")]
    for k, path in enumerate(names):
        if k != 2:
            load.load(numbers(spark, k + 1), path, "truncate")
    staged = {p: storage.stage(numbers(spark, 5), p) for p in names}
    seen = []

    def look(done):
        seen.append([load.read_dest(spark, p, "id bigint, v string").count() for p in names])
        for p in names:
            with pytest.raises(storage.PublicationBusy):
                storage.recover(spark, [p])
        with pytest.raises(storage.PublicationBusy):
            load.load(numbers(spark, 1), names[1], "truncate")

    with storage.watched_moves(look):
        storage.publish(spark, staged)
    assert seen == [[1, 2, 0]] * 5
    assert [load.read_dest(spark, p, "id bigint, v string").count() for p in names] == [5] * 3 and leftovers(names[0]) == []


def test_a_publication_that_was_taken_over_touches_nothing(spark, tmp_path, monkeypatch):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    load.truncate_all([(numbers(spark, 1), a), (numbers(spark, 2), b)])
    staged = {p: storage.stage(numbers(spark, 5), p) for p in (a, b)}

    def outlive(done):
        if done == 2:  # the first table is in place when another writer finds the lease run out
            storage._write_note(spark, storage.publication_of(spark, a).lease, "0")
            storage.recover(spark, [a])

    with pytest.raises(storage.LeaseLost), storage.watched_moves(outlive):
        storage.publish(spark, staged)
    assert ids(spark, a) == [0] and ids(spark, b) == [0, 1] and leftovers(a) == []


def test_plans_are_compiled_in_a_constant_number_of_jobs(spark):
    from tidemark.operators.projection import compile_plan, project

    def jobs(n):
        rows = [(f"public.t{k}", f"app.t{k}", f"c{i}", f"d{i}", "integer", "bigint", None, i == 2) for k in range(n) for i in (3, 2, 0, 1)]
        df = spark.createDataFrame(
            rows, "source_table string, dest_table string, source_column string, dest_column string, source_type string, "
            "default_dest_type string, override_dest_type string, skip boolean").repartition(7)
        spark.sparkContext.setJobGroup(f"plan{n}", "")
        try:
            plans = compile_plan(df)
            source = spark.range(3).selectExpr(*[f"cast(id as int) as c{i}" for i in range(4)])
            done = [project(source, plans[f"public.t{k}", f"app.t{k}"]) for k in range(0, n, 50)]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(plans) == n and all(d.columns == ["d0", "d1", "d3"] for d in done)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan{n}"))
    assert jobs(500) == jobs(2) <= 3


def test_a_destination_that_holds_a_source_is_refused(spark, tmp_path):
    numbers(spark, 7).write.parquet(f"{tmp_path}/base/t")
    rows = spark.read.parquet(f"{tmp_path}/base/t")
    for dest in (f"{tmp_path}/base/t", f"{tmp_path}/base", f"{tmp_path}/base/t/inner"):
        with pytest.raises(ValueError, match="the same"):
            load.load(rows, dest, "truncate")
        with pytest.raises(ValueError, match="the same"):
            load.truncate_all([(rows, dest)])
        for path in (None, f"{tmp_path}/base/t"):
            run, tables, _ = run_migration([TableMove("a.t", "a.t", rows, dest, [m("id", "bigint")], source_path=path)])
            assert "the same" in tables.first()["error"] and run.first()["status"] == "failed"
    assert spark.read.parquet(f"{tmp_path}/base/t").columns == ["id", "v"] and rows.count() == 7


def test_sink_and_scan_of_tables(spark, tmp_path):
    spark.sql(f"create database if not exists tide_test location '{tmp_path}/db'")
    spark.sql(f"create table tide_test.t (v string, id bigint) using parquet location '{tmp_path}/db/t'")
    try:
        sink(numbers(spark, 2), "tide_test.t", "append", "table")
        sink(numbers(spark, 2, 5), "tide_test.t", "append", "table")
        assert sorted(r["id"] for r in scan(spark, "tide_test.t", ["id"], "table").collect()) == [0, 1, 5, 6]
        sink(numbers(spark, 1, 9), "tide_test.t", "overwrite", "table")
        assert [tuple(r) for r in spark.table("tide_test.t").collect()] == [("v9", 9)]
    finally:
        spark.sql("drop database tide_test cascade")
    with pytest.raises(ValueError, match="partitionColumn"):
        scan(spark, "public.t", fmt="jdbc", url="jdbc:postgresql://unused/db")


def m(column, source_type, **more):
    return {"source_column": column, "dest_column": column, "source_type": source_type, "default_dest_type": source_type, **more}


ROW = [m("id", "bigint"), m("v", "text")]


def test_run_isolates_failures(spark, tmp_path):
    for name in ("full", "grown"):
        numbers(spark, 300, 1000).write.parquet(f"{tmp_path}/{name}")
    moves = [
        TableMove("public.good", "public.good", numbers(spark, 200), f"{tmp_path}/good", ROW, key=("id",),
                  sequences=(("id", "good_seq"),)),
        TableMove("public.bad", "public.bad", failing(spark), f"{tmp_path}/bad", ROW, key=("id",)),
        TableMove("public.full", "public.full", numbers(spark, 5), f"{tmp_path}/full", ROW, "abort"),
        TableMove("public.grown", "public.grown", numbers(spark, 50), f"{tmp_path}/grown", ROW, "append", "count_only", ("id",)),
        TableMove("public.skipped", "public.skipped", numbers(spark, 5), f"{tmp_path}/skipped", [m("id", "bigint", skip=True)]),
    ]
    run, tables, marks = run_migration(moves)
    got = {r["source_table"]: r for r in tables.collect()}
    assert {n: r["status"] for n, r in got.items()} == {
        "public.good": "succeeded", "public.bad": "failed", "public.full": "failed", "public.grown": "failed",
        "public.skipped": "failed"}
    assert "bad row" in got["public.bad"]["error"] and got["public.bad"]["rows_written"] is None
    assert got["public.full"]["error"] == "conflict_mode=abort but public.full has 300 rows"
    assert got["public.grown"]["error"].startswith("row_count: MISMATCH") and got["public.grown"]["rows_written"] == 50
    assert "every mapping is skipped" in got["public.skipped"]["error"]
    assert [v["name"] for v in got["public.good"]["verification"]] == ["row_count", "hash_sample", "sequence_parity"]
    summary = run.collect()[0]
    assert (summary["status"], summary["succeeded"], summary["failed"]) == ("failed", 1, 4) and summary["error"]
    assert [tuple(r) for r in marks.collect()] == [("public.good", "id", 199)]


def test_equal_pairs_are_checked_apart(spark, tmp_path):
    """Two moves with the same names: one destination is right, the other already held rows."""
    numbers(spark, 900, 5000).write.parquet(f"{tmp_path}/two")
    moves = [TableMove("a.t", "b.t", numbers(spark, 200), f"{tmp_path}/one", ROW, key=("id",)),
             TableMove("a.t", "b.t", numbers(spark, 200), f"{tmp_path}/two", ROW, "append", key=("id",))]
    _, tables, _ = run_migration(moves)
    got = tables.collect()
    assert [r["status"] for r in got] == ["succeeded", "failed"] and [len(r["verification"]) for r in got] == [3, 3]
    assert got[0]["verification"][0]["detail"] == "source=200 dest=200 (exact match)"


def test_an_unreadable_file_is_one_failed_check(spark, tmp_path):
    for name in ("good", "broken"):
        numbers(spark, 40).write.parquet(f"{tmp_path}/{name}")
    frames = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("good", "broken")}
    for part in (p for p in os.listdir(f"{tmp_path}/broken") if p.startswith("part-")):
        with open(f"{tmp_path}/broken/{part}", "wb") as f:
            f.write(b"no parquet here")
    pairs = [TablePair(n, n, numbers(spark, 40), frames[n], ("id",)) for n in ("good", "broken")]
    results, verdicts, status = verification_run(pairs)
    assert status == "failed" and {r["source_table"]: r["status"] for r in verdicts.collect()} == {"good": "passed", "broken": "failed"}
    errors = [r["error"] for r in results.filter("source_table = 'broken'").collect()]
    assert any(errors) and results.filter("source_table = 'good' and not passed").count() == 0


def test_clean_run_succeeds(spark, tmp_path):
    casted = [m("id", "bigint", override_dest_type="integer"), m("v", "text", override_dest_type="varchar(2)")]
    run, tables, _ = run_migration([TableMove("a.t", "b.t", numbers(spark, 150), f"{tmp_path}/t", casted, key=("id",),
                                              verification="count_sample_and_full_hash")])
    assert run.collect()[0]["status"] == "succeeded" and tables.collect()[0]["rows_read"] == 150
    assert spark.read.parquet(f"{tmp_path}/t").schema.simpleString() == "struct<id:int,v:string>"


def test_waves_put_parents_first_and_cycles_last(spark):
    empty = numbers(spark, 0)
    moves = [TableMove(n, n, empty, "/unused", ROW) for n in ("c", "x", "a", "y", "b")]
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("a", "elsewhere")], "child string, parent string")
    assert [[t.source_table for t in wave] for wave in load_waves(spark, moves, edges)] == [["a"], ["b"], ["c"], ["x", "y"]]


def test_included_plan_rows(spark):
    plan = spark.createDataFrame([("a", True, None), ("b", False, "count_only"), ("c", None, "count_only")],
                                 "source_table string, include boolean, verification string")
    assert {(r[0], r[2]) for r in included(plan).collect()} == {("a", "count_and_sample"), ("c", "count_only")}


def test_levels_against_brute_force(spark):
    random.seed(3)
    # a third of all edges share one parent; some edges point back and close cycles
    edges = [(random.randint(1, 400), 0) for _ in range(300)]
    edges += [(c, random.randint(0, c - 1)) for c in (random.randint(1, 400) for _ in range(500))]
    edges += [(10, 350), (350, 10), (5, 5), (399, 399)]
    nodes, parents = set(), {}
    for c, p in edges:
        nodes |= {c, p}
        if c != p:
            parents.setdefault(c, set()).add(p)
    level = {}
    while True:
        ready = [n for n in nodes if n not in level and all(p in level for p in parents.get(n, ()))]
        if not ready:
            break
        level.update({n: 1 + max((level[p] for p in parents.get(n, ())), default=-1) for n in ready})
    def above(n):
        seen, todo = set(), list(parents.get(n, ()))
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += parents.get(p, ())
        return seen
    on_cycle = {n for n in nodes if n in above(n)}
    got = {r["node"]: (r["level"], r["cyclic"], r["blocked"]) for r in graph.dependency_levels(
        spark.createDataFrame(edges, "child int, parent int")).collect()}
    assert got == {n: (level.get(n), n in on_cycle, n not in level and n not in on_cycle) for n in nodes}
    assert on_cycle and any(b for _, _, b in got.values())


def test_cycle_members_between_and_behind_cycles(spark):
    # two cycles, a path between them, a tail, a figure of eight and a chain into it
    edges = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("e", "f"), ("g", "f"), ("h", "i"), ("i", "h"), ("i", "j"),
             ("j", "i"), ("k", "k"), ("l", "m"), ("h", "l")]
    df = spark.createDataFrame(edges, "child string, parent string")
    assert sorted(r.node for r in graph.cycle_members(df).collect()) == list("abefhij")
    assert graph.cycle_members(df.limit(0)).collect() == []
    got = {r.node: (r.level, r.cyclic, r.blocked) for r in graph.dependency_levels(df).collect()}
    assert got["d"] == (None, False, True) and got["e"] == (None, True, False) and got["k"] == (0, False, False) and got["l"] == (1, False, False)


def test_large_cycle_is_one_component(spark):
    n = 24
    df = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(100 + i, i) for i in range(5)], "child int, parent int")
    assert sorted(r.node for r in graph.cycle_members(df).collect()) == list(range(n))


def random_updates(n, hot=True):
    random.seed(11)
    states = ["pending", "running", "succeeded", "failed", "skipped", "queued", "cancelled"]
    return [(1 if hot and i % 3 == 0 else random.randint(2, 60), random.randint(0, 5000), i, random.choice(states)) for i in range(n)]


ACTIVE, TERMINAL = {"pending", "queued", "running", "in_progress"}, {"succeeded", "passed", "failed", "cancelled"}


def test_transitions_against_brute_force_with_a_hot_run(spark):
    rows = random_updates(4000)
    want, last = [], {}
    for run, ts, i, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if last.get(run) in ACTIVE and status in TERMINAL:
            want.append((run, ts, i, last[run], status))
        last[run] = status
    df = spark.createDataFrame(rows, "run_id int, ts int, event_id int, status string")
    for slices in (64, 2):
        got = [(r["run_id"], r["ts"], r["event_id"], r["previous_status"], r["status"])
               for r in runs.status_transitions(df, ["run_id"], ["ts", "event_id"], slices=slices).collect()]
        assert sorted(got) == sorted(want)


def test_transitions_keep_time_order_for_every_stamp_type(spark):
    rows = [(1, f"2024-03-31 0{h}:30:00", h, s) for h, s in enumerate(["pending", "running", "failed", "pending", "succeeded"])]
    df = spark.createDataFrame(rows, "run_id int, ts string, event_id int, status string")
    for dtype in ("timestamp", "timestamp_ntz"):
        got = runs.status_transitions(df.withColumn("ts", F.col("ts").cast(dtype)), ["run_id"], ["ts", "event_id"]).collect()
        assert sorted(r["event_id"] for r in got) == [2, 4]
    assert runs.status_transitions(df.limit(0), ["run_id"], ["ts", "event_id"]).count() == 0


def test_polls_seed_and_forget(spark):
    polls = [(1, "m", "a", "running"), (1, "m", "b", "failed"), (1, "m", "c", "pending"), (1, "m", "d", "queued"),
             (5, "m", "a", "succeeded"), (5, "m", "b", "failed"), (5, "m", "d", "running"), (5, "v", "a", "passed"),
             (9, "m", "c", "succeeded"), (9, "m", "d", "cancelled"), (9, "m", "a", "failed")]
    df = spark.createDataFrame(polls, "poll int, type string, id string, status string")
    assert {tuple(r) for r in runs.poll_transitions(df).collect()} == {
        (5, "m", "a", "running", "succeeded"), (9, "m", "d", "running", "cancelled")}


def test_stream_matches_polls(spark, tmp_path):
    rows = random_updates(1200)
    polls = [rows[:400], rows[400:800], rows[800:]]
    want, last = [], {}
    session = streaming.stream_session(spark)
    schema = spark.createDataFrame([], "run_id int, ts int, event_id int, status string").schema
    for batch in polls:
        newest = {}
        for r in sorted(batch, key=lambda r: (r[1], r[2])):
            newest[r[0]] = r
        for run, r in newest.items():
            if last.get(run) in ACTIVE and r[3] in TERMINAL:
                want.append((run, r[1], r[2], last[run], r[3]))
            last[run] = r[3]
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.run_available(session, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want) and want


def test_activity_limits(spark, table):
    log = table("runs").withColumnRenamed("run_id", "id")
    for bad in (0, 501):
        with pytest.raises(ValueError):
            runs.activity(table("snapshots"), table("compared"), log, log, bad)
    feed = runs.activity(table("snapshots"), table("compared"), log, log, 7).collect()
    assert len(feed) == 28
    stamps = [r["finished_at"] or r["started_at"] for r in feed]
    assert stamps == sorted(stamps, reverse=True)


def test_negative_duration_is_null(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:01' as a, timestamp'2024-01-01 00:00:00' as b, cast(null as timestamp) as c")
    row = df.select(runs.duration_ms(F.col("a"), F.col("b")), runs.duration_ms(F.col("b"), F.col("a")),
                    runs.duration_ms(F.col("a"), F.col("c"))).collect()[0]
    assert tuple(row) == (None, 1000, None)


def test_stale_rows_keep_their_error(spark):
    log = spark.createDataFrame([(1, "failed"), (2, "running")], "run_id int, status string")
    tables = spark.createDataFrame(
        [(1, "a", "running", None, None), (1, "b", "pending", "old", "t0"), (1, "c", "succeeded", None, None), (2, "d", "running", None, None)],
        "run_id int, source_table string, status string, error string, finished_at string")
    got = {r["source_table"]: tuple(r)[2:] for r in runs.stale_tables(log, tables, F.lit("now")).collect()}
    assert got["a"] == ("failed", "stale: run terminated while this table was still in 'running' state. Re-run the migration to load this table.", "now", True)
    assert got["b"] == ("failed", "old", "t0", True)
    assert got["c"][0] == "succeeded" and got["d"] == ("running", None, None, False)


def test_transitions_of_one_run_and_one_stamp(spark):
    """A bulk load: 20 000 events of one run with one stamp are cut by the second order column."""
    rows = [(1, 7, i, "running" if i % 2 else "failed") for i in range(20_000)] + [(2, i, i, "running") for i in range(50)]
    df = spark.createDataFrame(rows, "run_id int, ts int, event_id int, status string")
    got = runs.previous_value(df, ["run_id"], ["ts", "event_id"], "status", "before", slices=16)
    want = {(1, i): None if i == 0 else ("running" if (i - 1) % 2 else "failed") for i in range(20_000)}
    want.update({(2, i): None if i == 0 else "running" for i in range(50)})
    assert {(r.run_id, r.event_id): r.before for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "_part" in plan


def test_timed_stream_forgets_idle_runs(spark, tmp_path):
    """Late, undated and delayed updates, a run that never ends, and state that holds only runs with recent news."""
    polls = [
        [(1, "2024-01-01 00:00:00.000001", 1, "running"), (2, "2024-01-02 00:00:00", 2, "running"), (3, None, 3, "running")],
        [(1, "2024-01-03 00:00:00", 4, "failed"), (4, "2024-02-20 00:00:00", 5, "running")],
        # run 2 begins anew, run 4 knows better, run 5 is too late
        [(2, "2024-02-19 12:00:00", 6, "failed"), (4, "2024-02-19 12:00:00", 7, "failed"), (5, "2024-02-01 00:00:00", 8, "running")],
        [(4, "2024-02-21 00:00:00", 9, "succeeded"), (4, "2024-02-20 12:00:00", 10, "running")],
    ]
    session = streaming.stream_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    for poll in polls:
        df = spark.createDataFrame(poll, "run_id int, ts string, event_id long, status string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        query = (
            streaming.timed_transitions(session.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "1 day", 30).writeStream
            .format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
            .trigger(availableNow=True).start())
        query.awaitTermination()
    got = {(r.run_id, str(r.ts), r.event_id, r.previous_status, r.status, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (1, "2024-01-03 00:00:00", 4, "running", "failed", "ended"),
        (2, "2024-01-02 00:00:00", 2, "running", None, "abandoned"),
        (4, "2024-02-21 00:00:00", 9, "running", "succeeded", "ended")}
    states = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "newest").load()
    assert {r.key.run_id for r in states.collect()} == {2, 4}
    with pytest.raises(ValueError, match="must be a timestamp"):
        streaming.timed_transitions(spark.createDataFrame([], "run_id int, ts string, event_id long, status string"))


def test_activity_sorts_keys_alone(spark, table):
    log = table("runs").withColumnRenamed("run_id", "id")
    plan = runs.activity(table("snapshots"), table("compared"), log, log, 7)._jdf.queryExecution().optimizedPlan().toString()
    limits = [n for n in plan.split("\n") if "GlobalLimit" in n]
    assert len(limits) == 4
    physical = runs.activity(table("snapshots"), table("compared"), log, log, 7)._jdf.queryExecution().executedPlan().toString()
    tops = [n for n in physical.split("\n") if "TakeOrderedAndProject" in n]
    assert tops and all("_stamp" in n and "detail" not in n and "label" not in n for n in tops)
