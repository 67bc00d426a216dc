"""Streaming queries over the event and document tables, drained to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators.series import in_utc, utc_clock
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources import bytelines
from labelloom.sources.session import work_path
from labelloom.streaming import progress as S
from labelloom.streaming import stateful

DAY = 24 * 3600


PARTS = 3


def _snapshots(spark, sf):
    return V.snapshot_rows(S.read_table_stream(spark, sf, "events"))


def _parts(df, column="ts"):
    """Rows in deliveries of equal length in time, oldest first."""
    low, high = df.agg(F.min(F.unix_micros(in_utc(F.col(column)))), F.max(F.unix_micros(in_utc(F.col(column))))).first()
    if low is None:
        return [df]
    part = F.least(F.floor((F.unix_micros(in_utc(F.col(column))) - low) * PARTS / (high - low + 1)), F.lit(PARTS - 1))
    return [df.filter(part == n) for n in range(PARTS)]


TORN = 97
TWICE = 10


@query("stream_progress", O.sql(["progress"], f"""
SELECT run_id, ts, event_id, fraction, detail FROM progress WHERE event_id % {TORN} <> 0"""))
def stream_progress(spark, sf):
    """Progress from JSON files: deliveries with torn texts, and with rows that were sent before."""
    folder, landed, sink = work_path(spark, "snapshots"), work_path(spark, "landed"), S.Sink(spark, "progress")
    state, archive = work_path(spark, "landing-state"), work_path(spark, "archive")
    rows, before = V.progress_snapshots(spark, sf), None
    for part in _parts(rows):
        part = part.withColumn("ts", in_utc(F.col("ts")))
        again = part.filter(F.col("event_id") % TWICE == 0)
        sent = part.unionByName(again) if before is None else part.unionByName(again).unionByName(before)
        before = again
        text = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        torn = F.when(F.col("event_id") % TORN == 0, F.substring(text, 1, 30)).otherwise(text)
        sent.select(torn.alias("value")).write.mode("append").text(folder)
        S.land_snapshots(spark, folder, landed, state, archive)
        got = sink.drain(S.progress_stream(S.read_landed(spark, landed), once=True))
    return got.withColumn("ts", utc_clock(F.col("ts")))


@query("stream_torn", f"SELECT count_if(event_id % {TORN} = 0)::BIGINT AS torn FROM events")
def stream_torn(spark, sf):
    """Torn snapshot files are set aside, whole."""
    folder, landed = work_path(spark, "snapshots"), work_path(spark, "landed")
    text = F.to_json(F.struct("run_id", "ts", "event_id", "body"))
    torn = F.when(F.col("event_id") % TORN == 0, F.substring(text, 1, 30)).otherwise(text)
    V.progress_snapshots(spark, sf).select(torn.alias("value")).write.text(folder)
    S.land_snapshots(spark, folder, landed, work_path(spark, "landing-state"))
    return S.read_torn(spark, landed).agg(F.count(F.lit(1)).alias("torn"))


@query("stream_latest_progress", O.sql(["host_progress"], """
SELECT run_id, ts, fraction, detail FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM host_progress
  WHERE run_id % 3 = 0 OR fraction > 0) WHERE rn = 1"""))
def stream_latest_progress(spark, sf):
    rows = _snapshots(spark, sf).withColumn("is_local", F.col("run_id") % 3 == 0)
    return S.current_progress(S.run_to_table(stateful.newest_progress(S.shown_progress(rows)), "latest"))


def _states(events):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("running")
    stage = F.when(kind == "view", "training").otherwise("evaluating")
    return events.select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), state.alias("state"), stage.alias("stage")
    )


def _delivered(spark, sf, name, make):
    """Drain ``make(stream)`` after each delivery of the event table."""
    folder, sink = work_path(spark, f"{name}-feed"), S.Sink(spark, name)
    events = V.table(spark, sf, "events")
    for part in _parts(events):
        part.write.mode("append").parquet(folder)
        got = sink.drain(make(_states(spark.readStream.schema(events.schema).parquet(folder))))
    return got


# What a stream knows for certain at the end of the feed.
_PASSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("stream_terminal", f"""
SELECT run_id, ts, seq, state FROM (
  SELECT user_id AS run_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('purchase','error')) WHERE rn = 1 AND ts <= {_PASSED}""")
def stream_terminal(spark, sf):
    """First ends; marks outlast the feed, so no run ends twice."""
    return _delivered(spark, sf, "terminal", lambda s: stateful.first_ends(s, keep=3650 * DAY))


HOUR = 3600
# The feed beats some times a day, so the allowed silences are hours where trackers have minutes.
LIMITS, OTHER = {"training": 10 * HOUR}, 2 * HOUR


@query("stream_lost_runs", f"""
WITH b AS (
  SELECT user_id AS run_id, ts, event_type, CASE event_type WHEN 'view' THEN 'training' ELSE 'evaluating' END AS stage,
         ts + CASE event_type WHEN 'view' THEN INTERVAL 10 HOUR ELSE INTERVAL 2 HOUR END AS lost_at,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events)
SELECT run_id, ts AS last_seen, stage, lost_at FROM b
WHERE event_type NOT IN ('purchase','error') AND (next_ts IS NULL OR next_ts > lost_at) AND lost_at <= {_PASSED}""")
def stream_lost_runs(spark, sf):
    """Silences longer than the stage of the last beat allows, found by timers."""
    return _delivered(spark, sf, "lost", lambda s: stateful.lost_runs(s, LIMITS, OTHER))


@query("stream_heartbeat", f"""
WITH b AS (SELECT user_id AS run_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL {DAY} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM b),
w AS (SELECT run_id, min(ts) AS start, max(ts) + INTERVAL {DAY} SECOND AS "end", count(*)::BIGINT AS beats,
             bool_or(event_type IN ('purchase','error')) AS finished FROM s GROUP BY run_id, no)
SELECT run_id, start, "end", beats, finished FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_heartbeat(spark, sf):
    """Closed sessions; sessions still open at the end of the feed are not lost yet."""
    states = _states(S.read_table_stream(spark, sf, "events"))
    return S.run_to_table(S.heartbeat_sessions(states, DAY), "sessions")


@query("stream_logs", O.sql(["log_lines"], """
SELECT run_id, pos, line FROM log_lines WHERE NOT contains(line,'remote port forwarding failed') AND NOT contains(line,'Permanently added')"""))
def stream_logs(spark, sf):
    """Log files that are tailed by byte offset, with files added between two drains."""
    folder, sink = work_path(spark, "log-feed"), S.Sink(spark, "logs")
    lines = V.log_lines(spark, sf)
    for part in (F.col("run_id") % 2 == 0, F.col("run_id") % 2 == 1):
        text = F.concat_ws("\t", F.col("run_id").cast("string"), F.col("pos").cast("string"), "line")
        lines.filter(part).select(text.alias("value")).write.mode("append").text(folder, lineSep="\n")
        cells = F.split("value", "\t", 3)
        rows = bytelines.tail_lines(spark, folder, "part-*").select(
            cells[0].cast("bigint").alias("run_id"), cells[1].cast("int").alias("pos"), cells[2].alias("line")
        )
        got = sink.drain(S.log_stream(rows))
    return got
