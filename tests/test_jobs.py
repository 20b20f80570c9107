import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.operators import jobs as J
from attesta.streaming import job_stream

SCHEMA = "id string, username string, run_ref string, status string, remote_status string, branch string, tier string, submitted_at timestamp, seq long"
T0 = dt.datetime(2024, 1, 1)


def job(i, user="u", status="queued", run=None, minutes=None):
    return (f"j{i}", user, run, status, None, None, "", T0 + dt.timedelta(minutes=i if minutes is None else minutes), i)


def test_history_limit_and_ties(spark):
    df = spark.createDataFrame([job(i, status="failed") for i in range(60)] + [job(100, "v", minutes=5), job(101, "v", minutes=5)], SCHEMA)
    got = J.user_history(df).orderBy("username", "position").collect()
    assert [r["id"] for r in got if r["username"] == "u"] == [f"j{i}" for i in range(59, 9, -1)]
    assert [r["id"] for r in got if r["username"] == "v"] == ["j100", "j101"]


def test_pruning_keeps_all_active(spark):
    df = spark.createDataFrame([job(i, status=["succeeded", "failed", "cancelled"][i % 3]) for i in range(55)]
                               + [job(i, status="running") for i in range(100, 170)], SCHEMA)
    kept = J.prune_history(df)
    assert kept.columns == df.columns and kept.count() == 120
    assert kept.filter("id IN ('j0','j4')").count() == 0


def test_upsert_ignores_unknown_ids_and_nulls(spark):
    jobs = J.create_jobs(spark.createDataFrame([("a", "u", "b", "t", 1)], "id string, username string, branch string, tier string, seq long"), F.lit(T0))
    changes = spark.createDataFrame([("a", "submitted", None, 1), ("a", None, "r1", 2), ("zz", "failed", None, 3)], "id string, status string, run_ref string, seq long")
    row = J.upsert_jobs(jobs, changes, ["status", "run_ref"]).collect()
    assert len(row) == 1 and (row[0]["status"], row[0]["run_ref"], row[0]["submitted_at"]) == ("submitted", "r1", T0)


def test_stale_and_cancel(spark):
    df = spark.createDataFrame([job(1, status="running"), job(2, status="running", run="r"), job(3, run=""), job(4, run="r"), job(5, "v")], SCHEMA)
    assert {r["id"]: (r["status"], r["remote_status"]) for r in J.reconcile_stale(df).collect()}["j1"] == ("failed", "App restarted")
    assert [r["status"] for r in J.cancel_queued(df, "u").orderBy("seq").collect()] == ["running", "running", "cancelled", "queued", "queued"]


def test_admission_rules(spark):
    df = spark.createDataFrame([job(1), job(2), job(3, "v"), job(4, "v", "running", "r"), job(5, "w", run="r"), job(6, "x")], SCHEMA)
    assert {r["id"] for r in J.admit_queued(df, 1).collect()} == {"j1", "j6"}
    assert {r["id"] for r in J.admit_queued(df, 1, legacy=True).collect()} == {"j6"}
    assert {r["id"] for r in J.admit_queued(df, 2).collect()} == {"j1", "j3", "j6"}


def test_status_words(spark):
    words = {"Queued": "pending", "EXECUTING": "running", "Successful": "succeeded", "error": "failed", "Archived": "cancelled", "": "submitted", "odd": "submitted"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", J.normalise_status(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == words


def test_history_view_marks_full_queue(spark):
    df = spark.createDataFrame([job(1), job(2, "v", "running", "r")], SCHEMA)
    got = {r["username"]: r for r in J.history_view(df).collect()}
    assert got["u"]["queue_full"] and not got["v"]["queue_full"]
    assert got["u"]["submitted"] == "2024-01-01 00:01" and got["u"]["branch"] == "—" and got["v"]["status"] == "RUNNING"


def test_status_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"r{i % 7}", ["Running", "Done", "odd", "Failed"][i % 4], i) for i in range(60)], "run_ref string, raw_status string, ts long")
    feed = str(tmp_path / "feed")
    events.repartitionByRange(6, "ts").write.parquet(feed)
    log = job_stream.run_status_log(spark, feed, str(tmp_path / "out"))
    jobs = spark.createDataFrame([job(i, status="running", run=f"r{i}") for i in range(9)], SCHEMA).withColumn("completed_at", F.lit(None).cast("timestamp"))
    now = F.lit(T0)
    batch, stream = J.apply_status(jobs, events, now), J.apply_status(jobs, log, now)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    assert log.select("batch").distinct().count() > 1


def test_status_stream_logs_changes_only_and_stays_in_the_jvm(spark, tmp_path, monkeypatch):
    feed = str(tmp_path / "feed")
    monkeypatch.setattr("pyspark.sql.group.GroupedData.transformWithStateInPandas", None)  # a Python call per run took too long
    waves = [[("a", 5, "Running"), ("b", 1, "Pending")], [("a", 4, "Done"), ("b", 1, "Pending"), ("c", None, "Done"), (None, 9, "Done")],
             [("a", 5, "Stopped"), ("b", 2, None), ("c", 3, "Failed")]]
    for rows in waves:
        spark.createDataFrame(rows, "run_ref string, ts long, raw_status string").coalesce(1).write.mode("append").parquet(feed)
    log = job_stream.run_status_log(spark, feed, str(tmp_path / "out"), files_per_batch=1)
    got = sorted(tuple(r) for r in log.select("batch", "run_ref", "ts", "raw_status").collect())
    assert got == [(0, "a", 5, "Running"), (0, "b", 1, "Pending"), (2, "a", 5, "Stopped"), (2, "c", 3, "Failed")]


def test_admission_stream_promotes_in_turn(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([job(i) for i in range(4)], SCHEMA).coalesce(1).write.parquet(feed)
    spark.createDataFrame([job(0, status="succeeded", run="run-j0"), job(9, "v")], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    log = job_stream.run_admission(spark, feed, str(tmp_path / "out"), max_jobs=1, files_per_batch=1)
    got = sorted((r["batch"], r["username"], r["id"]) for r in log.collect())
    assert len(got) >= 2 and len({g[2] for g in got}) == len(got)


def test_admission_waits_survive_a_batch_without_rows_of_the_user(spark, tmp_path):
    feed = str(tmp_path / "feed")
    waves = [[job(i, "u") for i in range(4)] + [job(8, None), job(9, "v", status=None)], [job(20, "w")],
             [job(21, "w", status="failed"), job(22, "x", run="r")], [job(20, "w", status="succeeded", run="run-j20"), job(23, "w")]]
    for rows in waves:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    log = job_stream.run_admission(spark, feed, str(tmp_path / "out"), max_jobs=3, files_per_batch=1)
    got = sorted((r["batch"], str(r["username"]), r["id"], r["active"]) for r in log.collect())
    assert got == [(0, "None", "j8", 0), (0, "u", "j0", 0), (1, "u", "j1", 1), (1, "w", "j20", 0), (2, "u", "j2", 2), (3, "w", "j23", 0)]


class _State:
    """A map state and a value state in memory that count what is asked of them."""

    def __init__(self):
        self.held, self.value, self.calls, self.timers = {}, None, 0, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return _Value()

    def registerTimer(self, _):  # noqa: N802
        self.timers += 1

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.calls += 1
            if name == "updateValue":
                self.held[key] = value
            elif name == "removeKey":
                del self.held[key]
            elif name == "containsKey":
                return key in self.held
            elif name == "iterator":
                return iter(list(self.held.items()))
            return self.held.get(key)
        return call


class _Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _admissions(batches, max_jobs):
    """What a plain replay of one user's batches of (id, status, run_ref, submitted, seq) admits."""
    held, out = {}, []
    for rows in batches:
        for row in sorted(rows, key=lambda r: int(r[4])):
            held[row[0]] = row
        held = {k: r for k, r in held.items() if r[1] not in job_stream.rules.COMPLETED_STATUSES}
        active = sum(r[1] in job_stream.rules.RUNNING_STATUSES for r in held.values())
        queue = sorted((int(r[3]), int(r[4]), k) for k, r in held.items() if r[1] == "queued")
        if queue and active < max_jobs and not held[queue[0][2]][2]:
            job = queue[0][2]
            held[job] = (job, "submitted", f"run-{job}", *held[job][3:])
            out.append((job, active))
    return out, set(held)


@pytest.mark.parametrize("block", [4, 256])
def test_admission_reads_and_writes_jobs_in_blocks(monkeypatch, block):
    import json
    import random
    monkeypatch.setattr(job_stream, "BLOCK", block, raising=False)
    rng, state, seq, batches, got = random.Random(3), _State(), 0, [], []
    kinds = ["queued"] * 6 + ["submitted", "running", "succeeded", "failed", None]
    for _ in range(12):
        rows = []
        for _ in range(300):
            seq += 1
            rows.append((f"j{rng.randrange(900)}", rng.choice(kinds), None, str(rng.randrange(50)), str(seq)))
        batches.append(rows)
    processor = job_stream.Admission(400, False)
    processor.init(state)
    for rows in batches:
        part = pd.DataFrame(rows, columns=["id", "status", "run_ref", "submitted", "seq"], dtype=object)
        for found in processor.handleInputRows(("u",), iter([part]), state):
            got += zip(found["id"], found["active"])
    want, still = _admissions(batches, 400)
    assert got == want and len(want) > 6
    if block == 256:
        assert state.calls < sum(map(len, batches)) / 20
    assert {job[0] for _, (jobs,) in state.held.items() for job in json.loads(jobs)} == still


def test_a_replayed_batch_gives_what_it_gave_before(spark, tmp_path, monkeypatch):
    feed = str(tmp_path / "feed")
    for wave in range(3):
        rows = [job(100 * wave + i, f"u{i % 5}") for i in range(20)] + [job(100 * (wave - 1) + i, f"u{i % 5}", "succeeded", "r") for i in range(0, 20, 3) if wave]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    whole = job_stream.run_admission(spark, feed, str(tmp_path / "whole"), max_jobs=2, files_per_batch=1)
    drain = job_stream._drain

    def breaking(stream, log_path, checkpoint):
        with job_stream._settings(spark, job_stream._STATE):
            def sink(batch, batch_id):
                batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
                if batch_id == 1:
                    raise RuntimeError("lost")
            query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="lost"):
            query.awaitTermination()

    monkeypatch.setattr(job_stream, "_drain", breaking)
    job_stream.run_admission(spark, feed, str(tmp_path / "parts"), max_jobs=2, files_per_batch=1)
    monkeypatch.setattr(job_stream, "_drain", drain)
    parts = job_stream.run_admission(spark, feed, str(tmp_path / "parts"), max_jobs=2, files_per_batch=1)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 8


def test_streaming_counts(spark, tmp_path):
    feed = str(tmp_path / "feed")
    df = spark.createDataFrame([job(i, f"u{i % 3}", ["queued", "failed"][i % 2]) for i in range(30)], SCHEMA)
    df.write.parquet(feed)
    stream = job_stream.active_counts_stream(spark.readStream.schema(df.schema).parquet(feed))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live").exceptAll(J.active_counts(df)).count() == 0
