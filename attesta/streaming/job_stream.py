"""Job status and admission as Structured Streaming with keyed state.

State lives in Spark's state store (RocksDB, below the stream's checkpoint): the latest status per run, the open jobs per
user. A batch touches the keys that it brings rows for and the users whose timer is due, nothing else. Output is
written to a folder per batch, in overwrite mode, so a replayed batch replaces its earlier attempt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta import rules

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # timers are looked at with the next rows
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """The settings a stream starts with; it keeps a copy, the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _drain(stream: DataFrame, log_path: str, checkpoint: str) -> None:
    """Run everything that is available now, each batch into its own folder, and stop."""
    with _settings(stream.sparkSession, _STATE):
        query = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}"))
                 .trigger(availableNow=True).start())
    query.awaitTermination()


def _read_feed(spark: SparkSession, feed: str, files_per_batch: int) -> DataFrame:
    schema = spark.read.parquet(feed).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed)


def _place(ts: str, df: DataFrame):
    """A time or number as the text of a whole number: exact in every batch, null or not."""
    kind = df.schema[ts].dataType.simpleString()
    return (F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else F.col(ts).cast("bigint")).cast("string")


def run_status_log(spark: SparkSession, feed: str, out: str, files_per_batch: int = 2) -> DataFrame:
    """Stream status events (run_ref, ts, raw_status; ``ts`` a timestamp or a whole number) into a log of status changes that
    ``apply_status`` reads: state per run (an aggregate in the JVM, with the batch that set it), a row only where a batch changes the
    run's latest status. Events without a run, a time or a status say nothing."""
    from attesta.operators import jobs as J

    events = _read_feed(spark, feed, files_per_batch)
    kind = events.schema["ts"].dataType.simpleString()
    now = F.unix_micros(F.current_timestamp())  # one time per batch, the same when the batch is replayed
    rows = events.select("run_ref", _place("ts", events).cast("bigint").alias("place"), "raw_status", (-now).alias("_since")).dropna()
    latest = (rows.groupBy("run_ref").agg(F.max(F.struct("place", "raw_status", "_since")).alias("s"))
              .filter(F.col("s._since") == -now).select("run_ref", "s.place", "s.raw_status"))
    ts = F.timestamp_micros("place") if kind.startswith("timestamp") else F.col("place")
    _drain(latest.select("run_ref", ts.cast(kind).alias("ts"), "raw_status", J.normalise_status(F.col("raw_status")).alias("status")),
           f"{out}/log", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/log")


def active_counts_stream(stream: DataFrame) -> DataFrame:
    """Running totals per user, held in Spark's state store; write in update or complete mode."""
    return stream.groupBy("username").agg(
        F.count_if(F.col("status").isin(*rules.ACTIVE_STATUSES)).alias("active"))


def run_active_counts(spark: SparkSession, feed: str, out: str, files_per_batch: int = 2) -> DataFrame:
    """Drain a feed of job rows through :func:`active_counts_stream`; the totals after the last batch."""
    stream = _read_feed(spark, feed, files_per_batch)
    query = (active_counts_stream(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint")
             .foreachBatch(lambda totals, _: totals.write.mode("overwrite").parquet(f"{out}/totals"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{out}/totals")


#: Open jobs of a user that are read and written at once.
BLOCK = 256


class Admission(StatefulProcessor):
    """Per user the jobs that are not completed, in blocks; with each batch at most one of the queued jobs is admitted.

    A user with a queue sets a timer, so that the next batch looks at them even if it brings none of their rows.
    """

    def __init__(self, max_jobs: int, legacy: bool):
        self.max_jobs, self.legacy = max_jobs, legacy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "no int", "jobs string")  # (id, status, run_ref, submitted, seq) each
        self.seen = handle.getValueState("seen", "at long, blocks int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict = {}  # of the batch's rows of each id the one with the largest seq
        for part in rows:
            for row in part[["id", "status", "run_ref", "submitted", "seq"]].itertuples(index=False, name=None):
                place = -1 if row[4] is None else int(row[4])
                if row[0] not in latest or place >= latest[row[0]][0]:
                    latest[row[0]] = (place, row)
        yield from self._admit(key, timerValues, {job: row for job, (_, row) in latest.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()
        if seen is None or seen[0] != timerValues.getCurrentProcessingTimeInMs():  # else this batch's rows were looked at
            yield from self._admit(key, timerValues, {})

    def _read(self, no: int) -> list:
        return json.loads(self.blocks.getValue((no,))[0])

    def _write(self, no: int, jobs: list) -> None:
        self.blocks.updateValue((no,), (json.dumps(jobs),))

    def _admit(self, key, timerValues, latest: dict) -> Iterator[pd.DataFrame]:
        """Merge the rows into the open jobs, block by block, and admit the first of the queue if there is room."""
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = self.seen.get()
        had = 0 if seen is None else seen[1]
        active, queued, first, full, changed = 0, 0, None, 0, False
        held: list = []  # open jobs not yet in a full block
        for no in range(had + 1):
            jobs = self._read(no) if no < had else list(latest.values())  # those left are new
            for job in jobs:
                row = latest.pop(job[0], None)
                changed |= row is not None
                _, status, run_ref, submitted, seq = job = job if row is None else row
                if status in rules.COMPLETED_STATUSES:
                    continue
                active += status in (rules.ACTIVE_STATUSES if self.legacy else rules.RUNNING_STATUSES)
                if status == "queued":
                    queued += 1
                    place = tuple((x is not None, x if x is None else int(x)) for x in (submitted, seq)) + ((job[0] is not None, job[0]),)
                    if first is None or place < first[0]:
                        first = (place, job, full * BLOCK + len(held))
                held.append(job)
            while len(held) >= BLOCK:
                if changed:
                    self._write(full, held[:BLOCK])
                held, full = held[BLOCK:], full + 1
        blocks = full + bool(held)
        if changed and held:
            self._write(full, held)
        for no in range(blocks, had):
            self.blocks.removeKey((no,))
        self.seen.update((now, blocks))
        free = active <= self.max_jobs if self.legacy else active < self.max_jobs
        if first is not None and free and not first[1][2]:
            (job, _, _, submitted, seq), at = first[1:]
            jobs = self._read(at // BLOCK)
            jobs[at % BLOCK] = (job, "submitted", f"run-{job}", submitted, seq)
            self._write(at // BLOCK, jobs)
            queued -= 1
            yield pd.DataFrame({"username": [key[0]], "id": [job], "active": [active]})
        if queued:
            self.handle.registerTimer(now + 1)

    def close(self) -> None:
        pass


def run_admission(spark: SparkSession, feed: str, out: str, max_jobs: int, legacy: bool = False,
                  files_per_batch: int = 2) -> DataFrame:
    """Per micro-batch: merge the batch's job rows (of each id the one with the largest ``seq``) into the open jobs, then
    admit at most one job per user. A job without a status stays open and is not admitted; a job stays with its user.

    Only jobs that are not completed are state, keyed by user: a batch reads and writes the users it brings rows for and
    those with a queue. An admitted job counts as submitted from the next batch on. Returns the admission log.
    """
    jobs = _read_feed(spark, feed, files_per_batch)
    rows = jobs.select("username", "id", "status", "run_ref", _place("submitted_at", jobs).alias("submitted"),
                       F.col("seq").cast("bigint").cast("string").alias("seq"))
    admitted = rows.groupBy("username").transformWithStateInPandas(
        Admission(max_jobs, legacy), "username string, id string, active long", "Update", "ProcessingTime")
    _drain(admitted, f"{out}/admitted", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/admitted")
