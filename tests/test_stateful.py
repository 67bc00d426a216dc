"""Streams with state and timers: several micro-batches against plain event-time rules, and state that goes away."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from labelloom.sources.session import work_path
from labelloom.streaming import progress as S
from labelloom.streaming import stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "run_id bigint, ts timestamp, seq bigint, state string, stage string"


def put(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(path, (1000 + len(os.listdir(folder)),) * 2)


def beat(run, second, seq, state="running", stage="training"):
    ts = None if second is None else (T0 + timedelta(seconds=second)).isoformat()
    return {"run_id": run, "ts": ts, "seq": seq, "state": state, "stage": stage}


def drained(spark, folder, make, schema=SCHEMA):
    """Rows sent out and the state rows after each micro-batch, one file a batch."""
    rows = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder))
    out, state = work_path(spark, "rows"), work_path(spark, "state")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    return spark.read.schema(rows.schema).parquet(out).collect(), held


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in")


def test_first_end_is_that_of_event_time_and_never_revived(spark, folder):
    put(folder, "1", [beat(1, 0, 1), beat(1, 500, 3, "failed"), beat(2, 10, 2), beat(None, 3, 9, "done"), beat(4, None, 8, "done")])
    put(folder, "2", [beat(1, 100, 4, "done"), beat(2, 300, 5, "done")])  # earlier end, later arrival
    put(folder, "3", [beat(9, 5000, 6)])
    put(folder, "4", [beat(1, 4900, 7, "failed"), beat(2, 5001, 8)])  # ended runs again
    put(folder, "5", [beat(9, 90_000, 9), beat(1, 20, 1, "done"), beat(3, 30, 1, "done")])  # late rows
    rows, held = drained(spark, folder, lambda s: stateful.first_ends(s, keep=20_000))
    got = sorted((r.run_id, (r.ts - T0).total_seconds(), r.seq, r.state) for r in rows)
    assert got == [(1, 100, 4, "done"), (2, 300, 5, "done")]
    assert max(held) > 0 and held[-1] == 0  # ends, timers and marks are all gone


def lost(beats, limits, other, passed):
    """Silences by the rule itself, over all beats at once."""
    out, by_run = [], {}
    for b in beats:
        if b["run_id"] is not None and b["ts"] is not None:
            by_run.setdefault(b["run_id"], []).append(((datetime.fromisoformat(b["ts"]) - T0).total_seconds(), b["seq"], b["state"], b["stage"]))
    for run, own in by_run.items():
        own.sort()
        for n, (at, _, state, stage) in enumerate(own):
            due = at + limits.get(stage, other)
            silent = n + 1 == len(own) or own[n + 1][0] > due
            if state not in ("done", "failed") and silent and due <= passed:
                out.append((run, at, stage, due))
    return sorted(out, key=str)


def test_a_silent_run_is_lost_without_further_beats(spark, folder):
    put(folder, "1", [beat(1, 0, 1), beat(2, 0, 2, stage="evaluating"), beat(3, 0, 3), beat(3, 30, 4, "done")])
    put(folder, "2", [beat(9, 1500, 5, "done")])  # time passes, no beat of the others
    put(folder, "3", [beat(9, 1501, 6, "done")])
    rows, held = drained(spark, folder, stateful.lost_runs)
    assert sorted((r.run_id, (r.lost_at - T0).total_seconds()) for r in rows) == [(1, 600), (2, 120)]
    assert held[-1] <= 4  # beats of run 9 and its timer


def test_lost_runs_do_not_depend_on_batches(spark, folder):
    rng, beats, at = random.Random(4), [], 0
    for seq in range(400):
        at += rng.choice([0, 5, 40, 90, 121, 300])
        state = rng.choice(["running"] * 5 + ["done"])
        beats.append(beat(rng.randrange(6), max(0, at - rng.randrange(500)), seq, state, rng.choice(["training", "evaluating"])))
    for n in range(5):  # unordered within the watermark's ten minutes
        put(folder, str(n), beats[n * 80 : n * 80 + 80])
    put(folder, "6", [beat(77, at + 5000, 999, "done")])
    rows, _ = drained(spark, folder, stateful.lost_runs)
    got = sorted(((r.run_id, (r.last_seen - T0).total_seconds(), r.stage, (r.lost_at - T0).total_seconds()) for r in rows), key=str)
    assert got == lost(beats, {"training": 600}, 120, at + 4400) and len(got) > 20


def test_newest_progress_forgets_silent_runs(spark, folder):
    row = lambda run, second, event, fraction: {
        "run_id": run, "ts": (T0 + timedelta(seconds=second)).isoformat(), "event_id": event, "fraction": fraction, "detail": f"d{event}"
    }
    put(folder, "1", [row(1, 0, 1, 0.1), row(1, 50, 2, 0.2), row(2, 10, 3, 0.5)])
    put(folder, "2", [row(1, 40, 4, 0.9), row(2, 60, 5, 0.6)])
    put(folder, "3", [row(3, 9000, 6, 1.0)])
    put(folder, "4", [row(3, 20_000, 7, 1.0)])
    schema = "run_id bigint, ts timestamp, event_id bigint, fraction double, detail string"
    rows, held = drained(spark, folder, lambda s: stateful.newest_progress(s, keep=3600), schema)
    assert [(r.run_id, r.event_id) for r in sorted(rows, key=lambda r: (r.run_id, r.event_id))] == [(1, 2), (2, 3), (2, 5), (3, 6), (3, 7)]
    assert held[-1] <= 2  # run 3 and its timer


def test_watermark_sees_rows_that_are_filtered(spark, folder):
    put(folder, "1", [beat(1, 10, 1, "done"), beat(2, 5000, 2, "running")])
    rows, _ = drained(spark, folder, stateful.first_ends)
    assert [r.run_id for r in rows] == [1]


def test_torn_snapshots_are_kept_aside_and_whole_ones_counted_once(spark, folder, tmp_path):
    landed, archive = str(tmp_path / "landed"), str(tmp_path / "archive")
    state, sink = work_path(spark, "land"), S.Sink(spark, "snaps")
    snap = lambda run, second, event: {
        "run_id": run, "ts": (T0 + timedelta(seconds=second)).isoformat(), "event_id": event, "body": '{"fraction": 0.5, "detail": "x"}'
    }
    put(folder, "1.json", [snap(1, 0, 1), snap(2, 5, 2)])
    with open(os.path.join(folder, "2.json"), "w") as f:
        f.write('{"run_id": 3, "ts": "2024-01-0')
    os.utime(os.path.join(folder, "2.json"), (1002, 1002))
    S.land_snapshots(spark, folder, landed, state, archive)
    assert sink.drain(S.progress_stream(S.read_landed(spark, landed), once=True)).count() == 2
    assert [r["value"] for r in S.read_torn(spark, landed).collect()] == ['{"run_id": 3, "ts": "2024-01-0']
    put(folder, "3.json", [snap(1, 0, 1), snap(1, 30, 3)])  # one is sent again
    S.land_snapshots(spark, folder, landed, state, archive)
    got = sink.drain(S.progress_stream(S.read_landed(spark, landed), once=True))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3]
    assert S.read_torn(spark, landed).count() == 1
