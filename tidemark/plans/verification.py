"""Stand-alone verification of many table pairs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark import fixed_values as fixed
from tidemark.operators.verify import RESULT, TablePair, overall, verify

RESULT_SCHEMA = (
    "pair bigint, source_table string, dest_table string, position bigint, name string, passed boolean, detail string, "
    "metrics map<string,string>, error string")


def _one_check(number: int, pair: TablePair, marks: DataFrame | None, name: str) -> list[tuple]:
    """The result of one check, or of its failure to run."""
    try:
        rows = verify([pair], marks, only=name).collect()
        return [(number, *(r[c] for c in RESULT[1:])) for r in rows]
    except Exception as e:
        position = pair.checks().index(name)
        return [(number, pair.source_table, pair.dest_table, position, name, False, fixed.CHECK_RAISED, {}, str(e))]


def run_checks(pairs: Sequence[TablePair], marks: DataFrame | None = None, batch: int = 100) -> DataFrame:
    """Results of all checks, numbered by pair; a check that cannot run is a failed result with its error.

    Pairs are checked ``batch`` at a time in one job each. Only when such a job fails, for whatever reason, is each of its
    checks run by itself, so one unreadable table costs the others nothing but time. What reaches the driver is a
    few rows per table.
    """
    spark = pairs[0].source.sparkSession
    rows = []
    for start in range(0, len(pairs), batch):
        some = pairs[start:start + batch]
        try:
            rows += [(start + r["pair"], *(r[c] for c in RESULT[1:])) for r in verify(some, marks).collect()]
        except Exception:
            rows += [row for k, p in enumerate(some) for name in p.checks() for row in _one_check(start + k, p, marks, name)]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def verification_run(pairs: Sequence[TablePair], marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(check results, per-table verdicts, run status) for the pairs that were selected."""
    if not pairs:
        raise ValueError(fixed.NOTHING_TO_VERIFY)
    results = run_checks(pairs, marks)
    verdicts = overall(results)
    status = "succeeded" if verdicts.filter("status = 'failed'").isEmpty() else "failed"
    return results, verdicts, status
