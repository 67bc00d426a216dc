"""Streams over files that arrive in several batches, against their batch twins."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelloom.operators import tracking
from labelloom.streaming import progress as S

T0 = datetime(2024, 1, 1)


def put(folder, name, rows, at):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(path, (at, at))


def snap(run, minute, event, fraction):
    return {
        "run_id": run, "ts": (T0 + timedelta(minutes=minute)).isoformat(), "event_id": event,
        "body": json.dumps({"fraction": fraction, "detail": f"d{event}"}),
    }


@pytest.fixture
def feed(tmp_path):
    folder = str(tmp_path / "feed")
    os.makedirs(folder)
    put(folder, "1.json", [snap(1, 0, 1, 0.1), snap(2, 0, 2, 0.0), snap(3, 0, 3, 0.0)], 1000)
    put(folder, "2.json", [snap(1, 9, 5, 0.5), snap(1, 4, 4, 0.3)], 2000)
    put(folder, "3.json", [snap(1, 6, 6, 0.9), snap(2, 9, 7, 0.2)], 3000)
    return folder


def test_latest_progress_ignores_late_snapshots(spark, feed):
    rows = spark.readStream.schema(S.SNAPSHOT_FILE_SCHEMA).option("maxFilesPerTrigger", 1).json(feed)
    rows = rows.withColumn("is_local", F.col("run_id") == 3)
    log = S.latest_progress_log(rows, "t")
    got = {r.run_id: (r.fraction, r.detail) for r in S.current_progress(log).collect()}
    assert got == {1: (0.5, "d5"), 2: (0.2, "d7"), 3: (0.0, "d3")}
    assert log.count() > 3
    batch = spark.read.schema(S.SNAPSHOT_FILE_SCHEMA).json(feed).withColumn("is_local", F.col("run_id") == 3)
    twin = tracking.latest_progress(tracking.normalise_progress(batch, source="host")).collect()
    assert {r.run_id: (r.fraction, r.detail) for r in twin} == got


def test_progress_once(spark, feed):
    put(feed, "4.json", [snap(1, 9, 5, 0.5)], 4000)
    stream = S.read_snapshot_stream(spark, feed)
    assert S.run_to_table(S.progress_stream(stream), "p").count() == 8
    stream = S.read_snapshot_stream(spark, feed)
    assert S.run_to_table(S.progress_stream(stream, once=True), "p").count() == 7


def test_first_terminal_state(spark, tmp_path):
    folder = str(tmp_path / "states")
    os.makedirs(folder)
    row = lambda run, minute, seq, state: {
        "run_id": run, "ts": (T0 + timedelta(minutes=minute)).isoformat(), "seq": seq, "state": state
    }
    put(folder, "1.json", [row(1, 0, 1, "running"), row(2, 1, 2, "failed")], 1000)
    put(folder, "2.json", [row(1, 5, 3, "done"), row(2, 6, 4, "done"), row(3, 6, 5, "running")], 2000)
    put(folder, "3.json", [row(1, 9, 6, "failed")], 3000)
    schema = "run_id bigint, ts timestamp, seq bigint, state string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    got = {r.run_id: (r.seq, r.state) for r in S.current_terminal(S.terminal_log(stream, "t")).collect()}
    assert got == {1: (3, "done"), 2: (2, "failed")}


def test_sessions_close_after_silence(spark, tmp_path):
    folder = str(tmp_path / "beats")
    os.makedirs(folder)
    row = lambda run, second, state="running": {
        "run_id": run, "ts": (T0 + timedelta(seconds=second)).isoformat(), "seq": second, "state": state
    }
    put(folder, "1.json", [row(1, 0), row(1, 60), row(2, 10), row(2, 70, "done")], 1000)
    put(folder, "2.json", [row(1, 600), row(9, 7200)], 2000)
    stream = spark.readStream.schema("run_id bigint, ts timestamp, seq bigint, state string").json(folder)
    rows = S.run_to_table(S.heartbeat_sessions(stream, 120), "s").collect()
    got = sorted((r.run_id, (r.start - T0).seconds, r.beats, r.finished) for r in rows)
    assert got == [(1, 0, 2, False), (1, 600, 1, False), (2, 10, 2, True)]


def test_log_feed(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.txt").write_text("step 1\nWarning: Permanently added x\nremote port forwarding failed for y\nstep 2\n")
    stream = spark.readStream.text(str(folder)).withColumnRenamed("value", "line")
    assert [r.line for r in S.run_to_table(S.log_stream(stream), "l").collect()] == ["step 1", "step 2"]


def test_table_stream_reads_a_file_or_a_folder(spark, sf, tmp_path):
    whole = S.read_table_stream(spark, sf, "events")
    want = S.run_to_table(whole.select("event_id"), "one").count()
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    parts = S.read_table_stream(spark, str(tmp_path), "events", files_per_trigger=2)
    assert S.run_to_table(parts.select("event_id"), "many").count() == want > 0
