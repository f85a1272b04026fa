"""Status transitions over a stream of run updates."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.fixed_values import ACTIVE_STATUSES, TERMINAL_STATUSES


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for one stream; its state is spread over as many partitions as the cluster has cores, twice.

    State lives in RocksDB, outside the heap; timers need it.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", str(2 * spark.sparkContext.defaultParallelism))
    return session


def _reduced(slim: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The newest update per run of every Arrow batch."""
    def newest_per_run(batches):
        for pdf in batches:
            yield pdf.sort_values([stamp, tie]).drop_duplicates(key, keep="last")

    return slim.mapInPandas(newest_per_run, slim.schema)


def transitions(updates: DataFrame, key: str = "run_id", stamp: str = "ts", tie: str = "event_id") -> DataFrame:
    """Runs that were active at their last poll and are terminal in this one.

    Each micro-batch is a poll. A run's newest update in the batch is its status; state per run is the status
    at its last poll while that was active, and the first poll of a run only seeds it. Updates are reduced
    to the newest per run in every Arrow batch before the shuffle and again chunk by chunk in the state
    function, so a run with very many updates needs neither memory nor a large shuffle.
    """
    key_type = updates.schema[key].dataType.simpleString()
    stamp_type = updates.schema[stamp].dataType.simpleString()
    tie_type = updates.schema[tie].dataType.simpleString()
    slim = updates.select(key, stamp, tie, "status")
    active, terminal = set(ACTIVE_STATUSES), set(TERMINAL_STATUSES)

    def advance(run, chunks, state):
        import pandas as pd

        newest = None
        for pdf in chunks:
            row = pdf.sort_values([stamp, tie]).iloc[-1]
            if newest is None or (row[stamp], row[tie]) > (newest[stamp], newest[tie]):
                newest = row
        if newest is None:
            return
        status = newest["status"]
        before = state.get[0] if state.exists else None
        if status in active:
            state.update((status,))
        elif state.exists:
            state.remove()
        if before is not None and status in terminal:
            yield pd.DataFrame({
                key: [run[0]], stamp: [newest[stamp]], tie: [newest[tie]],
                "previous_status": [before], "status": [status]})

    return _reduced(slim, key, stamp, tie).groupBy(key).applyInPandasWithState(
        advance,
        f"{key} {key_type}, {stamp} {stamp_type}, {tie} {tie_type}, previous_status string, status string",
        "status string", "append", "NoTimeout")


class _Timed(StatefulProcessor):
    """State of one run: its newest update and the timer that ends it. Stamps are whole microseconds in column ``stamp_micros``."""

    def __init__(self, key: str, tie: str, tie_type: str, idle_ms: int):
        self.key, self.tie, self.tie_type, self.idle_ms = key, tie, tie_type, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"micros long, tie {self.tie_type}, status string")

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.newest.get()) if self.newest.exists() else None
        found = before
        for pdf in rows:
            for update in zip(pdf["stamp_micros"].tolist(), pdf[self.tie].tolist(), pdf["status"].tolist()):
                if found is None or update[:2] > found[:2]:
                    found = update
        if found is before:
            return
        self.newest.update(found)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # timers are in whole milliseconds: the next one after the stamp
        self.handle.registerTimer(-(-found[0] // 1000) + self.idle_ms)
        if before is not None and before[2] in ACTIVE_STATUSES and found[2] in TERMINAL_STATUSES:
            yield self._row(key, found, before[2], found[2], "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = tuple(self.newest.get())
        self.newest.clear()
        if last[2] in ACTIVE_STATUSES:
            yield self._row(key, last, last[2], None, "abandoned")

    def close(self) -> None:
        pass

    def _row(self, key, update, before, status, outcome):
        import pandas as pd

        return pd.DataFrame({
            self.key: [key[0]], "stamp_micros": [update[0]], self.tie: [update[1]], "previous_status": [before],
            "status": pd.Series([status], dtype=object), "outcome": [outcome]})


def timed_transitions(
    updates: DataFrame, late: str = "1 day", idle_days: float = 30, key: str = "run_id", stamp: str = "ts", tie: str = "event_id",
) -> DataFrame:
    """Runs that were active and are terminal in this poll (``ended``), and active ones without news (``abandoned``).

    As :func:`transitions`, in event time. An update without a stamp, key or tie is ignored, and so is one that is not newer than
    the watermark, which follows the greatest stamp of earlier polls by ``late``. One that is in time but older than the
    newest known update of its run changes nothing. A run is forgotten once the watermark is ``idle_days`` past its
    newest update, so state holds the runs of that time and no others; an update that comes later begins the run anew.
    Terminal runs are kept until then too, lest a delayed update opens them again. ``stamp`` is an instant (``timestamp``).
    """
    types = {c: updates.schema[c].dataType.simpleString() for c in (key, stamp, tie)}
    if types[stamp] != "timestamp":
        raise ValueError(f"{stamp} must be a timestamp, not {types[stamp]}")
    known = updates.select(key, tie, "status", stamp, F.unix_micros(stamp).alias("stamp_micros")).filter(
        F.col(key).isNotNull() & F.col(stamp).isNotNull() & F.col(tie).isNotNull())
    # a run's newest update is late only if all are, and the greatest stamp stays, so that reducing first changes nothing
    found = _reduced(known, key, "stamp_micros", tie).withWatermark(stamp, late).groupBy(key).transformWithStateInPandas(
        _Timed(key, tie, types[tie], round(idle_days * 86_400_000)),
        f"{key} {types[key]}, stamp_micros long, {tie} {types[tie]}, previous_status string, status string, outcome string",
        "append", "EventTime")
    return found.select(key, F.timestamp_micros("stamp_micros").alias(stamp), tie, "previous_status", "status", "outcome")


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, build=transitions, **options,
) -> None:
    """Process the update files that arrived since the last call as one poll and append its transitions to ``out``.

    ``build`` is :func:`transitions` or :func:`timed_transitions`, with its options.
    """
    updates = spark.readStream.schema(schema).parquet(source)
    query = (
        build(updates, **options).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
