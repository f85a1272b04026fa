"""Run-log queries."""

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import runs
from tidemark.sources.storage import scratch_path
from tidemark.streaming import transitions as streaming
from workloads.derived import duck, table
from workloads.registry import query

ACTIVE = "('pending', 'queued', 'running', 'in_progress')"
TERMINAL = "('succeeded', 'passed', 'failed', 'cancelled')"
SQL_INTROSPECTION = """
    select 'introspection' as type, id::varchar as id, 'Introspect: ' || coalesce(connection_name, connection_id::varchar) as label,
           'succeeded' as status, captured_at as started_at, captured_at as finished_at,
           table_count || ' tables, ' || warning_count || ' warnings' as detail from {source}"""
SQL_COMPARISON = """
    select 'comparison' as type, id::varchar as id, 'Comparison (' || case when source_schema is not null then 'schema ' ||
             source_schema || ' → ' || dest_schema else 'all schemas' end || ')' as label,
           case when common + only_source + only_dest > 0 then 'succeeded' else 'running' end as status, created_at as started_at,
           case when common + only_source + only_dest > 0 then created_at end as finished_at,
           case when common + only_source + only_dest > 0 then common || ' common, ' || only_source || ' only-in-source, ' ||
             only_dest || ' only-in-dest' else 'computing…' end as detail from {source}"""
SQL_RUN = """
    select '{kind}' as type, id::varchar as id, '{title} (' || table_count || ' table' || case when table_count <> 1 then 's' else '' end
             || ')' as label, status, coalesce(started_at, created_at) as started_at, finished_at, nullif(error, '') as detail
    from {source}"""


def sql_run(kind, source):
    return SQL_RUN.replace("{kind}", kind).replace("{title}", kind.capitalize()).replace("{source}", source)


def newest(source, stamp, key="id", n=50):
    return f"(select * from {source} order by {stamp} desc, {key} desc limit {n}) n"


STAMPS = ("type, id, label, status, started_at::varchar as started_at, finished_at::varchar as finished_at, detail, "
          "case when datediff('millisecond', started_at, finished_at) >= 0 then datediff('millisecond', started_at, finished_at) "
          "end as duration_ms")


def sql_activity(n):
    run_rows = "(select run_id as id, * from {runs}) r"
    return " union all ".join([
        SQL_INTROSPECTION.replace("{source}", newest("{snapshots}", "captured_at", n=n)),
        SQL_COMPARISON.replace("{source}", newest("{compared}", "created_at", n=n)),
        sql_run("migration", newest(run_rows, "created_at", n=n)),
        sql_run("verification", newest("(select run_id as id, * from {runs} where table_count > 0) r", "created_at", n=n))])


def run_log(spark, sf_dir):
    return table(spark, sf_dir, "runs").withColumnRenamed("run_id", "id")


def texts(df):
    return df.withColumn("started_at", F.col("started_at").cast("string")).withColumn(
        "finished_at", F.col("finished_at").cast("string"))


def _register_activity():
    for name, n, kind in (("activity", 50, None), ("activity_of_migrations", 500, "migration")):
        where = f" where type = '{kind}'" if kind else ""

        @query(name, duck(f"select {STAMPS} from ({sql_activity(n)}) a{where}"))
        def build(spark, sf_dir, n=n, kind=kind):
            log = run_log(spark, sf_dir)
            return texts(runs.activity(
                table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "compared"), log, log.filter("table_count > 0"), n, kind))


_register_activity()


@query("activity_entries", duck(f"""
    select type, id, label, status, started_at::varchar as started_at, finished_at::varchar as finished_at, detail from (
      {SQL_INTROSPECTION.replace('{source}', '{snapshots}')} union all {SQL_COMPARISON.replace('{source}', '{compared}')}
      union all {sql_run('migration', '(select run_id as id, * from {runs}) r')}
      union all {sql_run('verification', '(select run_id as id, * from {runs}) r')}) a"""))
def activity_entries(spark, sf_dir):
    log = run_log(spark, sf_dir)
    parts = [runs.introspection_entries(table(spark, sf_dir, "snapshots")),
             runs.comparison_entries(table(spark, sf_dir, "compared")),
             runs.run_entries(log, "migration"), runs.run_entries(log, "verification")]
    return texts(reduce(lambda a, b: a.unionByName(b), parts))


@query("migration_runs_summary", duck("""
    select r.run_id, r.status, r.started_at::varchar as started_at, r.finished_at::varchar as finished_at,
           (select count(*) from {run_tables} t where t.run_id = r.run_id) as table_count, r.created_at::varchar as created_at
    from {runs} r"""))
def migration_runs_summary(spark, sf_dir):
    found = runs.migration_runs_summary(table(spark, sf_dir, "runs"), table(spark, sf_dir, "run_tables"))
    return texts(found).withColumn("created_at", F.col("created_at").cast("string"))


@query("verification_runs_summary", duck("""
    select r.run_id, r.status, coalesce(t.n, 0) as table_count, coalesce(t.p, 0) as pass_count, coalesce(t.f, 0) as fail_count
    from {runs} r left join (select run_id, count(*) as n, count(*) filter (status = 'passed') as p,
      count(*) filter (status = 'failed') as f from {checked_tables} group by run_id) t on t.run_id = r.run_id"""))
def verification_runs_summary(spark, sf_dir):
    found = runs.verification_runs_summary(table(spark, sf_dir, "runs"), table(spark, sf_dir, "checked_tables"))
    return found.select("run_id", "status", "table_count", "pass_count", "fail_count")


@query("run_totals", duck("""
    select run_id, cast(sum(coalesce(rows_read, 0)) as bigint) as rows_read, cast(sum(coalesce(rows_written, 0)) as bigint) as rows_written,
           count(*) filter (status = 'running') as running, count(*) filter (status = 'pending') as pending,
           count(*) filter (status = 'failed') as failed, count(*) filter (status = 'succeeded') as succeeded,
           count(*) filter (status = 'skipped') as skipped from {run_tables} group by run_id"""))
def run_totals(spark, sf_dir):
    return runs.run_totals(table(spark, sf_dir, "run_tables"))


@query("ranked_tables", duck("""
    select run_id, source_table, line, case status when 'running' then 0 when 'pending' then 1 when 'failed' then 2
      when 'succeeded' then 3 when 'skipped' then 4 else 99 end as status_rank from {run_tables}"""))
def ranked_tables(spark, sf_dir):
    return runs.ranked_tables(table(spark, sf_dir, "run_tables")).select("run_id", "source_table", "line", "status_rank")


@query("stale_tables", duck("""
    select t.run_id, t.source_table, t.line, case when stale then 'failed' else t.status end as status, t.rows_read, t.rows_written,
           case when stale then coalesce(nullif(t.error, ''), 'stale: run terminated while this table was still in ''' || t.status ||
             ''' state. Re-run the migration to load this table.') else t.error end as error, t.started_at::varchar as started_at,
           (case when stale then coalesce(t.finished_at, timestamp '2030-01-01 00:00:00') else t.finished_at end)::varchar as finished_at,
           stale as changed
    from (select t.*, coalesce(r.status in ('succeeded', 'failed', 'cancelled'), false) and t.status in ('running', 'pending') as stale
          from {run_tables} t left join {runs} r on r.run_id = t.run_id) t"""))
def stale_tables(spark, sf_dir):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return texts(runs.stale_tables(table(spark, sf_dir, "runs"), table(spark, sf_dir, "run_tables"), now))


@query("status_transitions", duck(f"""
    select run_id, event_id, ts::varchar as ts, previous_status, status from (
      select *, lag(status) over (partition by run_id order by ts, event_id) as previous_status from {{updates}}) t
    where previous_status in {ACTIVE} and status in {TERMINAL}"""))
def status_transitions(spark, sf_dir):
    found = runs.status_transitions(table(spark, sf_dir, "updates"), ["run_id"], ["ts", "event_id"])
    return found.withColumn("ts", F.col("ts").cast("string"))


@query("poll_transitions", duck(f"""
    select p.poll::varchar as poll, p.type, p.id, b.status as previous_status, p.status
    from (select *, dense_rank() over (order by poll) as n from {{polls}}) p
    join (select *, dense_rank() over (order by poll) as n from {{polls}}) b on b.type = p.type and b.id = p.id and b.n = p.n - 1
    where b.status in {ACTIVE} and p.status in {TERMINAL}"""))
def poll_transitions(spark, sf_dir):
    return runs.poll_transitions(table(spark, sf_dir, "polls")).withColumn("poll", F.col("poll").cast("string"))


STREAM_CUTS = ["2024-01-08", "2024-01-16", "2024-01-24"]
SQL_POLL_NO = " + ".join(f"case when ts >= timestamp '{c} 00:00:00' then 1 else 0 end" for c in STREAM_CUTS)


@query("stream_transitions", duck(f"""
    select run_id, event_id, ts::varchar as ts, previous_status, status from (
      select *, lag(status) over (partition by run_id order by poll) as previous_status from (
        select *, row_number() over (partition by run_id, poll order by ts desc, event_id desc) as rn
        from (select *, {SQL_POLL_NO} as poll from {{updates}}) u) p where rn = 1) t
    where previous_status in {ACTIVE} and status in {TERMINAL}"""))
def stream_transitions(spark, sf_dir):
    """The whole update log as a stream that arrives in four polls; state survives between the runs of the query."""
    session = streaming.stream_session(spark)
    base = scratch_path(spark, "stream")
    updates = table(spark, sf_dir, "updates")
    bounds = [None, *STREAM_CUTS, None]
    for low, high in zip(bounds, bounds[1:]):
        arrived = updates
        if low:
            arrived = arrived.filter(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        if high:
            arrived = arrived.filter(F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        arrived.write.mode("append").parquet(f"{base}/updates")
        streaming.run_available(session, f"{base}/updates", updates.schema, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("string"))


LATE_DAYS, IDLE_DAYS = 2, 3
#: Every seventh update arrives a poll late, every eleventh has lost its stamp.
SQL_ARRIVED = f"""arrived as (
    select run_id, event_id, status, case when event_id % 11 = 0 then null else ts end as ts,
           {SQL_POLL_NO} + case when event_id % 7 = 0 then 1 else 0 end as poll from {{updates}})"""
SQL_MARKS = f"""marks as (
    select poll, mark, lag(mark) over (order by poll) as mark_before from (
      select poll, max(max(ts)) over (order by poll) - interval {LATE_DAYS} day as mark from arrived group by poll) m)"""
SQL_NEWEST = """newest as (
    select a.run_id, a.poll, a.ts, a.event_id, a.status, m.mark_before from (
      select *, row_number() over (partition by run_id, poll order by ts desc, event_id desc) as rn from arrived where ts is not null) a
    join marks m on m.poll = a.poll where a.rn = 1 and a.run_id is not null and (m.mark_before is null or a.ts > m.mark_before))"""
SQL_CHANGES = """changes as (
    select *, lead(poll) over (partition by run_id order by poll) as next_poll from (
      select *, max(struct_pack(t := ts, e := event_id, s := status)) over (
        partition by run_id order by poll rows between unbounded preceding and 1 preceding) as known from newest) c
    where known is null or ts > known.t or (ts = known.t and event_id > known.e))"""


@query("stream_transitions_late", duck(f"""
    select run_id, event_id, ts::varchar as ts, known.s as previous_status, status, 'ended' as outcome from changes
    where known.s in {ACTIVE} and status in {TERMINAL} and (mark_before is null or known.t + interval {IDLE_DAYS} day >= mark_before)
    union all
    select run_id, event_id, ts::varchar, status, null, 'abandoned' from (
      select *, (select min(m.poll) from marks m where m.poll >= c.poll and c.ts + interval {IDLE_DAYS} day < m.mark) as ends
      from changes c where status in {ACTIVE}) x where ends is not null and (next_poll is null or ends < next_poll)""",
    SQL_ARRIVED, SQL_MARKS, SQL_NEWEST, SQL_CHANGES))
def stream_transitions_late(spark, sf_dir):
    """The whole update log in polls with late updates and updates without a stamp; runs without news leave the state."""
    session = streaming.stream_session(spark)
    base = scratch_path(spark, "stream")
    updates = table(spark, sf_dir, "updates").select(
        "run_id", "event_id", "status",
        F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp")).alias("ts"),
        (F.expr(SQL_POLL_NO) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("poll"))
    for poll in range(len(STREAM_CUTS) + 2):
        arrived = updates.filter(F.col("poll") == poll).drop("poll")
        arrived.write.mode("append").parquet(f"{base}/updates")
        streaming.run_available(
            session, f"{base}/updates", arrived.schema, f"{base}/out", f"{base}/checkpoint", build=streaming.timed_transitions,
            late=f"{LATE_DAYS} days", idle_days=IDLE_DAYS)
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("string"))
