"""The order of results that promise one; comparisons with twins sort both sides."""

from pyspark.sql import functions as F

from tidemark.operators import audit, mapping, runs
from workloads.audits import plan_state, preflight_of
from workloads.mappings import seeded


def test_run_summaries_come_newest_first(table):
    for build, log in ((runs.migration_runs_summary, "run_tables"), (runs.verification_runs_summary, "checked_tables")):
        rows = build(table("runs"), table(log)).select("created_at", "run_id").collect()
        assert len(rows) == table("runs").count()
        assert all(a.created_at > b.created_at or (a.created_at == b.created_at and a.run_id < b.run_id) for a, b in zip(rows, rows[1:]))


def test_tables_of_a_run_come_by_rank_and_name(table):
    rows = [(r.run_id, r.status_rank, r.source_table) for r in runs.ranked_tables(table("run_tables")).collect()]
    assert rows and rows == sorted(rows)


def test_mappings_come_by_table_and_column(spark, sf_dir):
    rows = [tuple(r) for r in mapping.ordered_mappings(seeded(spark, sf_dir)).select("comparison_id", "source_table", "source_column").collect()]
    assert rows and rows == sorted(rows)
    summary = [tuple(r)[:2] for r in mapping.mapping_summary(seeded(spark, sf_dir)).collect()]
    assert summary and summary == sorted(summary)


def test_findings_come_by_severity_then_size(spark, sf_dir):
    rows = audit.finding_rollup(preflight_of(spark, sf_dir)).collect()
    keys = [(["error", "warning", "info"].index(r.severity), -r.findings, r.code) for r in rows]
    assert keys and keys == sorted(keys)
    placed = audit.wiped_rollup(preflight_of(spark, sf_dir), plan_state(spark, sf_dir)).orderBy("position").collect()
    assert [tuple(r)[1:4] for r in placed] == [tuple(r) for r in rows]
    lost = audit.would_truncate_counts(plan_state(spark, sf_dir)).agg(F.sum("rows_lost")).first()[0]
    assert sum(r.rows_wiped for r in placed) == lost > 0
