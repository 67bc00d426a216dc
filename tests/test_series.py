"""Ordered operators against brute force, with many blocks and a hot run."""

import random
from datetime import datetime, timedelta

import pytest

from labelloom.operators import series, tracking


def history(seed, hot=400):
    rng = random.Random(seed)
    rows, step = [], 0
    for _ in range(900):
        step += rng.randint(1, 3)
        run = 0 if rng.random() < hot / 900 else rng.randint(1, 12)
        rows.append((run, step, None if rng.random() < 0.2 else round(rng.random() * rng.choice([1, 5]), 2)))
    return rows


def brute_stop(rows, patience):
    out = {}
    for run in {r[0] for r in rows}:
        best, waited = None, 0
        for _, step, loss in sorted(r for r in rows if r[0] == run and r[2] is not None):
            if best is None or loss < best:
                best, waited = loss, 0
            else:
                waited += 1
            if waited >= patience:
                out[run] = step
                break
    return out


@pytest.mark.parametrize("seed, patience, block", [(1, 3, 7), (2, 5, 50), (3, 20, 13), (4, 3, 1_000_000), (5, 40, 100)])
def test_early_stop(spark, seed, patience, block):
    rows = history(seed)
    df = spark.createDataFrame(rows, "run_id int, step int, eval_loss double")
    got = {r.run_id: r.stop_step for r in series.early_stop(df, patience, block_steps=block).collect()}
    assert got == brute_stop(rows, patience)


def test_early_stop_when_every_eval_improves(spark):
    df = spark.range(500).selectExpr("1 as run_id", "cast(id as int) as step", "1000.0 - id as eval_loss")
    assert series.early_stop(df, 1, block_steps=11).count() == 0


def test_metrics(spark):
    rows = history(9)
    df = spark.createDataFrame(rows, "run_id int, step int, eval_loss double")
    known = [r for r in rows if r[2] is not None]
    last = {run: max((s, v) for k, s, v in known if k == run) for run in {r[0] for r in known}}
    best = {run: min((v, s) for k, s, v in known if k == run) for run in {r[0] for r in known}}
    assert {r.run_id: (r.step, r.eval_loss) for r in series.last_metric(df).collect()} == last
    assert {r.run_id: (r.eval_loss, r.step) for r in series.best_checkpoint(df).collect()} == best


@pytest.mark.parametrize("timeout", [60, 120, 3600])
def test_heartbeat_gaps(spark, timeout):
    rng = random.Random(timeout)
    start, rows = datetime(2024, 1, 1), []
    for run, n in ((0, 600), (1, 40), (2, 1)):
        at = start
        for _ in range(n):
            at += timedelta(microseconds=rng.choice([1, timeout * 900_000, timeout * 1_000_000, timeout * 1_000_001, timeout * 2_500_000]))
            rows.append((run, at))
    want = set()
    for run in range(3):
        times = [t for k, t in rows if k == run]
        want |= {(run, a, b) for a, b in zip(times, times[1:]) if (b - a) > timedelta(seconds=timeout)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id int, ts timestamp_ntz")
    got = series.heartbeat_gaps(df, timeout).collect()
    assert {(r.run_id, r.last_seen, r.next_seen) for r in got} == want and len(got) == len(want)


def test_tail_and_cheapest(spark):
    lines = spark.range(300).selectExpr("id % 2 as run", "id as pos", "concat('l', id) as line")
    got = series.tail(lines, "run", "pos", 50).collect()
    assert sorted(r.pos for r in got) == list(range(200, 300))
    offers = [("g", 1, None), ("g", 2, 3.0), ("g", 3, 2.0), ("g", 4, 2.0), ("h", 5, None), ("h", 6, None)]
    best = series.cheapest(spark.createDataFrame(offers, "gpu string, id int, price double"), "gpu", "price", "id")
    assert {r.gpu: r.id for r in best.collect()} == {"g": 3, "h": 5}


PROGRESS = [
    ('{"step": 50, "max_steps": 100, "epoch": 1.0, "loss": 0.5555}', 0.5, "epoch=1.0  loss=0.5555"),
    ('{"step": 80, "max_steps": 100, "epoch": 1.6, "eval_loss": 0.321}', 0.8, "epoch=1.6  eval_loss=0.3210"),
    ('{"step": 5, "max_steps": 0}', 0.0, "epoch=?"),
    ('{"fraction": 0.25, "detail": "stage 2"}', 0.25, "stage 2"),
    ('{"fraction": 0.25}', 0.25, ""),
    ("{broken", 0.0, ""),
    ("", 0.0, ""),
    (None, 0.0, ""),
]


def test_progress(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PROGRESS)], "i int, body string")
    got = {r.i: (r.fraction, r.detail) for r in tracking.normalise_progress(df, source="host").collect()}
    assert got == {i: p[1:] for i, p in enumerate(PROGRESS)}
    text = '{"step":1,"max_steps":4,"epoch":0.5,"elapsed_s":9,"loss":1.0,"grad_norm":2.5}'
    row = tracking.normalise_progress(spark.createDataFrame([(text,)], "body string")).first()
    assert row.detail == "step=1/4  epoch=0.5  elapsed=9s  loss=1.0000  grad_norm=2.5000"


def test_percent_lines(spark):
    from pyspark.sql import functions as F

    from labelloom.functions.text import first_number_in_parens, slug

    cases = [
        ("x\nValid: 19/20 (95.0%)  [PASS]\n", 0.95),
        ("Valid: none (n/a%)\nValid: 1/2 (50%)", 0.5),
        ("Valid: 5% of (60.5%) y", 0.605),
        (" Valid: 1/2 (50%)", None),
        ("Valid: 1/2 (50 percent)", None),
        ("", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", first_number_in_parens(F.col("t")).alias("p")).collect()}
    assert got == {i: pytest.approx(c[1]) if c[1] is not None else None for i, c in enumerate(cases)}
    names = spark.createDataFrame([("My Model v2!",), ("---",), ("a" * 60,), ("É x",)], "n string")
    assert [r[0] for r in names.select(slug(F.col("n"))).collect()] == ["my-model-v2", "model", "a" * 50, "x"]


def test_state_maps(spark):
    from pyspark.sql import functions as F

    from labelloom.functions import constants as C

    df = spark.createDataFrame([("RUNNING",), ("EXITED",), ("odd",), (None,)], "s string")
    assert [r[0] for r in df.select(tracking.mapped_state(F.col("s"), C.POD_STATES)).collect()] == ["running", "pending", "pending", "pending"]
    keys = [("name", "r", "m", "p"), ("", "r", "m", "p"), (None, "", "m", "p"), (None, None, "", "out.gz")]
    rows = spark.createDataFrame(keys, "n string, r string, m string, p string")
    assert [r[0] for r in rows.select(tracking.artifact_key(*[F.col(c) for c in "nrmp"])).collect()] == [
        "gguf/name.gguf.gz", "workflow/r/model.gguf.gz", "gguf/m.gguf.gz", "out.gz",
    ]
    ids = spark.createDataFrame([("vastai/1",), ("ssh/x/y",), ("ssh",), ("other/1",), ("",)], "i string")
    assert [r[0] for r in ids.select(tracking.backend_of(F.col("i"))).collect()] == ["vastai", "ssh", "", "", ""]
