"""Job history and queue admission over a table of jobs (one row per job id).

Columns used: id, username, run_ref, status, remote_status, branch, tier, submitted_at, completed_at, seq
(``seq`` is the insertion order that breaks ties).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta import rules


def _no_run() -> Column:
    return F.coalesce(F.col("run_ref"), F.lit("")) == ""


def _newest(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    # A plain "rank <= n" filter lets Spark cut every group to n rows per task before the shuffle.
    order = Window.partitionBy(*keys).orderBy(F.col("submitted_at").desc_nulls_last(), F.col("seq"))
    return df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def user_history(jobs: DataFrame, limit: int = rules.HISTORY_LIMIT) -> DataFrame:
    """Every user's newest jobs; ``position`` 1 is the newest."""
    return _newest(jobs, ["username"], limit)


def active_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("username").agg(F.count_if(F.col("status").isin(*rules.ACTIVE_STATUSES)).alias("active"))


def _first_queued() -> Column:
    entry = F.struct("submitted_at", "seq", "id", "run_ref")
    return F.min(F.when(F.col("status") == "queued", entry))


def oldest_queued(jobs: DataFrame) -> DataFrame:
    """Per user with queued jobs: the earliest queued one."""
    queued = jobs.filter(F.col("status") == "queued")
    return (queued.groupBy("username").agg(_first_queued().alias("j"))
            .select("username", "j.id", "j.submitted_at", "j.run_ref"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*rules.RUNNING_STATUSES))


def queued_users(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "queued").select("username").distinct()


def prune_history(jobs: DataFrame, limit: int = rules.HISTORY_LIMIT) -> DataFrame:
    """All jobs that are not completed, and each user's newest completed ones."""
    done = F.coalesce(F.col("status").isin(*rules.COMPLETED_STATUSES), F.lit(False))
    completed = jobs.filter(done).withColumn("_user", F.coalesce("username", F.lit("")))
    return jobs.filter(~done).unionByName(_newest(completed, ["_user"], limit).drop("_user", "position"))


def create_jobs(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """New queued rows from (id, username, branch, tier, seq)."""
    return requests.select(
        "id", "username", F.lit(None).cast("string").alias("run_ref"), "branch", "tier",
        F.lit("queued").alias("status"), F.lit(None).cast("string").alias("remote_status"),
        (now if now is not None else F.current_timestamp()).alias("submitted_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), "seq")


def upsert_jobs(jobs: DataFrame, changes: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """Overwrite ``fields`` by each id's latest non-null change; changes of unknown ids do nothing."""
    latest = changes.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"new_{f}") for f in fields])
    merged = jobs.join(latest, "id", "left")
    return merged.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                           for c in jobs.columns])


def reconcile_stale(jobs: DataFrame) -> DataFrame:
    """Jobs that claim to run but have no run reference have failed."""
    stale = F.col("status").isin(*rules.RUNNING_STATUSES) & _no_run()
    return jobs.withColumns({
        "status": F.when(stale, "failed").otherwise(F.col("status")),
        "remote_status": F.when(stale, "App restarted").otherwise(F.col("remote_status"))})


def cancel_queued(jobs: DataFrame, username: str) -> DataFrame:
    hit = (F.col("username") == username) & (F.col("status") == "queued") & _no_run()
    return jobs.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def normalise_status(raw: Column) -> Column:
    """Raw status text to one of the known states; anything else counts as submitted."""
    lowered, out = F.lower(raw), F.lit("submitted")
    for status, synonyms in rules.STATUS_SYNONYMS.items():
        out = F.when(lowered.isin(*synonyms), F.lit(status)).otherwise(out)
    return out


def job_status(df: DataFrame, sources: Sequence[str], unreachable: str | None = None) -> DataFrame:
    """``remote_status`` from the first non-empty source field and its normalised ``local_status``."""
    raw = F.coalesce(*[F.nullif(F.col(s), F.lit("")) for s in sources], F.lit(""))
    out = df.withColumns({"remote_status": raw, "local_status": normalise_status(raw)})
    if unreachable is None:
        return out
    lost = F.coalesce(F.col(unreachable), F.lit(False))
    return out.withColumns({
        "remote_status": F.when(lost, "unknown").otherwise(F.col("remote_status")),
        "local_status": F.when(lost, "running").otherwise(F.col("local_status"))})


def apply_status(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Copy each run's latest status event (run_ref, raw_status, ts) onto its active job."""
    latest = (events.filter(F.coalesce("run_ref", F.lit("")) != "").groupBy(F.col("run_ref").alias("_key"))
              .agg(F.max_by("raw_status", "ts").alias("_raw")))
    active = F.coalesce(F.col("status").isin(*rules.RUNNING_STATUSES), F.lit(False)) & ~_no_run()
    # Jobs that need no status get a key of their own: missing run references would otherwise meet in one task.
    key = F.when(active, F.concat(F.lit("r"), F.col("run_ref"))).otherwise(F.concat(F.lit("-"), F.col("id")))
    joined = jobs.withColumn("_key", key).join(latest.withColumn("_key", F.concat(F.lit("r"), F.col("_key"))), "_key", "left")
    live, local = F.col("_raw").isNotNull(), normalise_status(F.col("_raw"))
    done = live & local.isin(*rules.COMPLETED_STATUSES)
    new = {"status": F.when(live, local).otherwise(F.col("status")),
           "remote_status": F.when(live, F.col("_raw")).otherwise(F.col("remote_status")),
           "completed_at": F.when(done, now).otherwise(F.col("completed_at"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def admit_queued(jobs: DataFrame, max_jobs: int = 1, legacy: bool = False) -> DataFrame:
    """Per user with a free slot: the queued job to submit next.

    ``legacy`` counts the queued jobs themselves as active and admits while the count is not above the limit.
    """
    statuses = rules.ACTIVE_STATUSES if legacy else rules.RUNNING_STATUSES
    per_user = jobs.groupBy("username").agg(
        F.count_if(F.col("status").isin(*statuses)).alias("active"), _first_queued().alias("j"))
    free = F.col("active") <= max_jobs if legacy else F.col("active") < max_jobs
    return (per_user.filter(F.col("j").isNotNull() & free & (F.coalesce("j.run_ref", F.lit("")) == ""))
            .select("username", "active", "j.id", "j.submitted_at"))


def history_view(jobs: DataFrame, limit: int = rules.HISTORY_LIMIT) -> DataFrame:
    """Display rows of :func:`user_history` with the active split and the queue-full flag per user."""
    def dash(col: Column) -> Column:
        return F.coalesce(F.nullif(col, F.lit("")), F.lit("—"))

    status = F.coalesce("status", F.lit("queued"))
    queued = (F.col("status") == "queued") & _no_run()
    stamp = F.date_format("submitted_at", "yyyy-MM-dd HH:mm")
    return user_history(jobs, limit).select(
        "username", "position", "id", dash(F.col("branch")).alias("branch"), dash(F.col("tier")).alias("tier"),
        F.upper(status).alias("status"), dash(stamp).alias("submitted"),
        status.isin(*rules.ACTIVE_STATUSES).alias("is_active"),
        F.max(queued).over(Window.partitionBy("username")).alias("queue_full"))
