"""Family H on ``events``: a user is a submitter, an event a job, its type the job's status."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import safe_float, safe_int
from attesta.operators import jobs as J
from attesta.plans.catalog import ORACLES, bind, plain, query, table

JOBS = """SELECT cast(event_id AS string) AS id, concat('user_', cast(user_id AS string)) AS username,
  CASE WHEN value >= 10 THEN concat('run-', cast(event_id AS string)) END AS run_ref,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'running'
       WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
  'idle' AS remote_status, CASE WHEN value < 50 THEN 'main' END AS branch,
  CASE WHEN value >= 20 THEN 'small' ELSE '' END AS tier, ts AS submitted_at, event_id AS seq FROM {events}"""
WITH_JOBS = f"WITH jobs AS ({plain(JOBS)}) "
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SQL_ISO = "strftime(submitted_at, '%Y-%m-%dT%H:%M:%S.%f')"
ACTIVE4 = "('queued','submitted','pending','running')"
ACTIVE3 = "('submitted','pending','running')"


def jobs(spark, sf_dir):
    return bind(spark, sf_dir, JOBS)


def _iso(df):
    return df.withColumn("submitted_at", F.date_format("submitted_at", ISO))


@query("h01_user_history", WITH_JOBS + f"""SELECT username, position, id, status, {SQL_ISO} AS submitted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY submitted_at DESC, seq) AS position FROM jobs)
  WHERE position <= 50""")
def h01(spark, sf_dir):
    return _iso(J.user_history(jobs(spark, sf_dir))).select("username", "position", "id", "status", "submitted_at")


@query("h02_active_counts", WITH_JOBS + f"""SELECT username, count(*) FILTER (status IN {ACTIVE4}) AS active
  FROM jobs GROUP BY username""")
def h02(spark, sf_dir):
    return J.active_counts(jobs(spark, sf_dir))


@query("h03_oldest_queued", WITH_JOBS + f"""SELECT username, id, {SQL_ISO} AS submitted_at, run_ref FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY submitted_at, seq) AS rn FROM jobs
  WHERE status = 'queued') WHERE rn = 1""")
def h03(spark, sf_dir):
    return _iso(J.oldest_queued(jobs(spark, sf_dir)))


@query("h04_active_jobs", WITH_JOBS + f"SELECT id, username, status FROM jobs WHERE status IN {ACTIVE3}")
def h04(spark, sf_dir):
    return J.active_jobs(jobs(spark, sf_dir)).select("id", "username", "status")


@query("h05_queued_users", WITH_JOBS + "SELECT DISTINCT username FROM jobs WHERE status = 'queued'")
def h05(spark, sf_dir):
    return J.queued_users(jobs(spark, sf_dir))


@query("h06_prune_history", WITH_JOBS + """SELECT id, username, status FROM (SELECT *,
  row_number() OVER (PARTITION BY username, status IN ('succeeded','failed','cancelled')
                     ORDER BY submitted_at DESC, seq) AS rn FROM jobs)
  WHERE status NOT IN ('succeeded','failed','cancelled') OR rn <= 50""")
def h06(spark, sf_dir):
    return J.prune_history(jobs(spark, sf_dir)).select("id", "username", "status")


# Orders are the created jobs; every line item is one change of a job, some for ids that were never created.
REQUESTS = """SELECT cast(o_orderkey AS string) AS id, concat('user_', cast(o_custkey AS string)) AS username,
  o_orderpriority AS branch, 'small' AS tier, o_orderkey AS seq FROM {orders}"""
CHANGES = """SELECT cast(l_orderkey + 100 AS string) AS id,
  CASE WHEN l_quantity > 25 THEN concat('s', l_returnflag) END AS status,
  CASE WHEN l_linestatus = 'F' THEN concat('run-', cast(l_partkey AS string)) END AS run_ref,
  l_suppkey * 100000000 + l_partkey * 1000 + l_linenumber AS seq FROM {lineitem}"""


@query("h07_upsert_job", f"""WITH requests AS ({plain(REQUESTS)}), changes AS ({plain(CHANGES)}),
  s AS (SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
        FROM changes WHERE status IS NOT NULL) WHERE rn = 1),
  r AS (SELECT id, run_ref FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
        FROM changes WHERE run_ref IS NOT NULL) WHERE rn = 1)
  SELECT q.id, q.username, q.branch, q.tier, coalesce(s.status, 'queued') AS status, r.run_ref
  FROM requests q LEFT JOIN s ON s.id = q.id LEFT JOIN r ON r.id = q.id""")
def h07(spark, sf_dir):
    created = J.create_jobs(bind(spark, sf_dir, REQUESTS))
    merged = J.upsert_jobs(created, bind(spark, sf_dir, CHANGES), ["status", "run_ref"])
    return merged.select("id", "username", "branch", "tier", "status", "run_ref")


@query("h08_reconcile_stale", WITH_JOBS + f"""SELECT id,
  CASE WHEN status IN {ACTIVE3} AND run_ref IS NULL THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN {ACTIVE3} AND run_ref IS NULL THEN 'App restarted' ELSE remote_status END AS remote_status
  FROM jobs""")
def h08(spark, sf_dir):
    return J.reconcile_stale(jobs(spark, sf_dir)).select("id", "status", "remote_status")


@query("h09_cancel_queued", WITH_JOBS + """SELECT id, username, CASE WHEN username = 'user_8' AND status = 'queued'
  AND run_ref IS NULL THEN 'cancelled' ELSE status END AS status FROM jobs""")
def h09(spark, sf_dir):
    return J.cancel_queued(jobs(spark, sf_dir), "user_8").select("id", "username", "status")


RAW_STATUS = """SELECT event_id,
  CASE event_type WHEN 'click' THEN 'Executing' WHEN 'signup' THEN 'Provisioning' WHEN 'view' THEN '' END AS s1,
  CASE WHEN event_type = 'purchase' THEN 'Completed' WHEN event_type = 'view' AND value < 30 THEN 'Stopped' ELSE '' END
    AS s2,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value < 60 THEN 'Odd' ELSE '' END AS s3,
  value > 200 AS lost FROM {events}"""


@query("h10_normalise_status", f"""WITH j AS (SELECT event_id, lost,
  coalesce(nullif(s1, ''), nullif(s2, ''), nullif(s3, ''), '') AS raw FROM ({plain(RAW_STATUS)}))
  SELECT event_id, CASE WHEN lost THEN 'unknown' ELSE raw END AS remote_status,
  CASE WHEN lost THEN 'running'
       WHEN lower(raw) IN ('succeeded','success','successful','completed','complete','done','finished') THEN 'succeeded'
       WHEN lower(raw) IN ('failed','error') THEN 'failed'
       WHEN lower(raw) IN ('stopped','cancelled','canceled','archived') THEN 'cancelled'
       WHEN lower(raw) IN ('running','executing') THEN 'running'
       WHEN lower(raw) IN ('queued','pending','initializing','provisioning') THEN 'pending'
       ELSE 'submitted' END AS local_status FROM j""")
def h10(spark, sf_dir):
    out = J.job_status(bind(spark, sf_dir, RAW_STATUS), ["s1", "s2", "s3"], unreachable="lost")
    return out.select("event_id", "remote_status", "local_status")


# A run's status events are the events that follow its own one by one and by two.
STATUS_EVENTS = """SELECT concat('run-', cast(event_id - 1 AS string)) AS run_ref, event_id AS ts,
  CASE event_type WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'Running' ELSE 'Pending' END
    AS raw_status FROM {events}
  UNION ALL SELECT concat('run-', cast(event_id - 2 AS string)), event_id,
  CASE WHEN value > 50 THEN 'Stopped' ELSE 'Initializing' END FROM {events}"""


@query("h11_apply_status", WITH_JOBS + f""", ev AS ({plain(STATUS_EVENTS)}),
  latest AS (SELECT run_ref, raw_status FROM (SELECT *, row_number() OVER (PARTITION BY run_ref ORDER BY ts DESC) AS rn
             FROM ev) WHERE rn = 1),
  j AS (SELECT jobs.*, raw_status, CASE raw_status WHEN 'Done' THEN 'succeeded' WHEN 'Failed' THEN 'failed'
          WHEN 'Running' THEN 'running' WHEN 'Stopped' THEN 'cancelled' ELSE 'pending' END AS local,
          raw_status IS NOT NULL AND status IN {ACTIVE3} AS live
        FROM jobs LEFT JOIN latest ON latest.run_ref = jobs.run_ref)
  SELECT id, CASE WHEN live THEN local ELSE status END AS status,
  CASE WHEN live THEN raw_status ELSE remote_status END AS remote_status,
  live AND local IN ('succeeded','failed','cancelled') AS completed FROM j""")
def h11(spark, sf_dir):
    base = jobs(spark, sf_dir).withColumn("completed_at", F.lit(None).cast("timestamp"))
    out = J.apply_status(base, bind(spark, sf_dir, STATUS_EVENTS), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("id", "status", "remote_status", F.col("completed_at").isNotNull().alias("completed"))


def _admit_sql(statuses, cond):
    return WITH_JOBS + f""", c AS (SELECT username, count(*) FILTER (status IN {statuses}) AS active
  FROM jobs GROUP BY username), o AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY username ORDER BY submitted_at, seq) AS rn FROM jobs WHERE status = 'queued') WHERE rn = 1)
  SELECT c.username, active, id, {SQL_ISO} AS submitted_at FROM c JOIN o ON o.username = c.username
  WHERE active {cond} AND run_ref IS NULL"""


@query("h12_admit_queued", _admit_sql(ACTIVE3, "< 30"))
def h12(spark, sf_dir):
    return _iso(J.admit_queued(jobs(spark, sf_dir), max_jobs=30))


@query("h12_admit_queued_legacy", _admit_sql(ACTIVE4, "<= 45"))
def h12_legacy(spark, sf_dir):
    return _iso(J.admit_queued(jobs(spark, sf_dir), max_jobs=45, legacy=True))


@query("h13_history_view", WITH_JOBS + f""", h AS (SELECT *, row_number() OVER
  (PARTITION BY username ORDER BY submitted_at DESC, seq) AS position FROM jobs)
  SELECT username, position, id, coalesce(nullif(branch, ''), '—') AS branch, coalesce(nullif(tier, ''), '—') AS tier,
  upper(status) AS status, strftime(submitted_at, '%Y-%m-%d %H:%M') AS submitted,
  status IN {ACTIVE4} AS is_active,
  bool_or(status = 'queued' AND run_ref IS NULL) OVER (PARTITION BY username) AS queue_full
  FROM h WHERE position <= 50""")
def h13(spark, sf_dir):
    return J.history_view(jobs(spark, sf_dir))


NUMBER_TEXT = """SELECT event_id, CASE event_type WHEN 'click' THEN concat(' ', cast(user_id AS string), ' ')
  WHEN 'view' THEN '' WHEN 'error' THEN 'abc' WHEN 'signup' THEN concat('1_', cast(user_id AS string))
  ELSE concat('-', cast(user_id AS string), '.5e1') END AS raw FROM {events}"""


@query("h14_safe_number", f"""SELECT event_id,
  CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+(_[0-9]+)*$')
       THEN TRY_CAST(replace(trim(raw), '_', '') AS BIGINT) END AS as_int,
  CASE WHEN trim(raw) <> '' AND raw <> 'abc' THEN TRY_CAST(replace(trim(raw), '_', '') AS DOUBLE) END AS as_float
  FROM ({plain(NUMBER_TEXT)})""")
def h14(spark, sf_dir):
    return bind(spark, sf_dir, NUMBER_TEXT).select(
        "event_id", safe_int(F.col("raw")).alias("as_int"), safe_float(F.col("raw")).alias("as_float"))


@query("h11_status_stream", ORACLES["h11_apply_status"])
def h11_stream(spark, sf_dir):
    from attesta.session import scratch_path
    from attesta.streaming import job_stream

    base = jobs(spark, sf_dir).withColumn("completed_at", F.lit(None).cast("timestamp"))
    feed = scratch_path(spark, "status-feed")
    bind(spark, sf_dir, STATUS_EVENTS).write.parquet(feed)
    log = job_stream.run_status_log(spark, feed, scratch_path(spark, "status-log"))
    out = J.apply_status(base, log, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("id", "status", "remote_status", F.col("completed_at").isNotNull().alias("completed"))


# Jobs arrive in three batches, every fifth a second time in the same batch: a later row without a status.
ARRIVALS = f"""SELECT *, cast(id AS bigint) % 3 AS wave FROM ({JOBS}) j UNION ALL
  SELECT id, username, run_ref, CASE WHEN cast(id AS bigint) % 10 = 0 THEN NULL ELSE 'succeeded' END AS status, remote_status, branch,
    tier, submitted_at, seq + 1000000000 AS seq, cast(id AS bigint) % 3 AS wave FROM ({JOBS}) j WHERE cast(id AS bigint) % 5 = 0"""


def _replay_sql(waves: int, limit: int) -> str:
    sql = f"WITH arrivals AS ({plain(ARRIVALS)}), latest AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
    for w in range(waves):
        before = f"SELECT o.* FROM open{w - 1} o ANTI JOIN (SELECT id FROM latest WHERE wave = {w}) USING (id) UNION ALL " if w else ""
        sql += f""", jobs{w} AS ({before}SELECT * FROM latest WHERE wave = {w}),
  c{w} AS (SELECT username, count(*) FILTER (status IN {ACTIVE3}) AS active FROM jobs{w} GROUP BY username),
  a{w} AS (SELECT username, id, active FROM (SELECT * FROM jobs{w} WHERE status = 'queued' QUALIFY row_number() OVER
    (PARTITION BY username ORDER BY submitted_at, seq) = 1) JOIN c{w} USING (username) WHERE active < {limit} AND coalesce(run_ref, '') = ''),
  open{w} AS (SELECT j.* REPLACE (CASE WHEN a.id IS NULL THEN j.status ELSE 'submitted' END AS status,
    CASE WHEN a.id IS NULL THEN j.run_ref ELSE concat('run-', j.id) END AS run_ref) FROM jobs{w} j LEFT JOIN a{w} a USING (id)
    WHERE a.id IS NOT NULL OR j.status IS NULL OR j.status NOT IN ('succeeded', 'failed', 'cancelled'))"""
    return sql + " " + " UNION ALL ".join(f"SELECT username, id, active, {w}::INT AS batch FROM a{w}" for w in range(waves))


@query("h12_admission_stream", _replay_sql(3, 30))
def h12_stream(spark, sf_dir):
    from attesta.session import scratch_path
    from attesta.streaming import job_stream

    feed = scratch_path(spark, "job-feed")
    rows = bind(spark, sf_dir, ARRIVALS)
    for wave in range(3):  # a file each, in order
        rows.filter(F.col("wave") == wave).drop("wave").coalesce(1).write.mode("append").parquet(feed)
    return job_stream.run_admission(spark, feed, scratch_path(spark, "admissions"), max_jobs=30, files_per_batch=1)


@query("h02_active_counts_stream", WITH_JOBS + f"""SELECT username, count(*) FILTER (status IN {ACTIVE4}) AS active FROM jobs GROUP BY username""")
def h02_stream(spark, sf_dir):
    from attesta.session import scratch_path
    from attesta.streaming import job_stream

    feed, out = scratch_path(spark, "job-feed"), scratch_path(spark, "active-counts")
    jobs(spark, sf_dir).write.parquet(feed)
    return job_stream.run_active_counts(spark, feed, out)
