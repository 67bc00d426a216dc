"""Nothing is lost or capped, and results don't depend on the session's time zone."""

from labelloom.operators import resample, tracking
from labelloom.sources import results
import pytest
from pyspark.sql import functions as F

from labelloom.operators import quality, series
from labelloom.sources import jsonl, session


def test_lines_survive_a_changed_split_plan(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(20_000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).coalesce(1).write.text(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        numbered = jsonl.number_lines(jsonl.read_lines(spark, path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        rows = numbered.select("line_no", "value").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i + 1, f"line {i}") for i in range(20_000)]


def test_every_violation_is_listed(spark):
    rows = spark.createDataFrame([(f"c{i % 30:02}",) for i in range(60)], "class string")
    with pytest.raises(ValueError) as stop:
        quality.require_balance(quality.class_balance(rows, "class"))
    assert all(f"c{i:02}" in str(stop.value) for i in range(30))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_gaps_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        beats = spark.sql("""SELECT 1L AS run_id, t AS ts FROM VALUES (timestamp_ntz'2024-03-10 01:59:00'),
                             (timestamp_ntz'2024-03-10 02:30:00'), (timestamp_ntz'2024-03-10 03:01:00.5') AS v(t)""")
        gaps = series.heartbeat_gaps(beats, 600).select(F.col("last_seen").cast("string"), "gap_seconds").collect()
        clock = beats.select(series.utc_clock(series.in_utc(F.col("ts"))).cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert sorted(map(tuple, gaps)) == [("2024-03-10 01:59:00", 1860.0), ("2024-03-10 02:30:00", 1860.5)]
    assert [r[0] for r in clock] == ["2024-03-10 01:59:00", "2024-03-10 02:30:00", "2024-03-10 03:01:00.5"]


def test_lost_predictions_count(spark):
    expected = spark.createDataFrame([(1, "EAT"), (2, "EAT"), (3, "IDLE")], "id long, expected string")
    predicted = spark.createDataFrame([(1, "EAT")], "id long, predicted string")
    totals, classes = quality.action_accuracy(predicted, expected, "id")
    assert totals.select("total", "correct").first() == (3, 1)
    assert {r["predicted"]: r["n"] for r in classes.collect()} == {"EAT": 1, "[INVALID]": 2}


def test_rows_without_class_stop_the_job(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "kind string")
    with pytest.raises(Exception, match="row without kind"):
        quality.class_weights(rows, "kind").collect()


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_progress_semantics(spark):
    bodies = {
        "{}": (0.0, "epoch=?"), '{"loss":0.5}': (0.0, "epoch=?  loss=0.5000"), "[1]": (0.0, ""), "": (0.0, ""),
        '{"step":10.0,"max_steps":20}': (0.5, "epoch=?"), '{"step":1,"max_steps":2,"loss":null}': (0.0, ""),
        '{"step":1,"max_steps":0,"epoch":2.0}': (0.0, "epoch=2.0"), '{"step":"1","max_steps":2}': (0.0, ""),
        '{"step":1,"max_steps":2,"epoch":null}': (0.5, "epoch=None"), '{"fraction":0.25,"detail":"x"}': (0.25, "x"),
    }
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.body: (r.fraction, r.detail) for r in tracking.normalise_progress(frame, source="host").collect()}
    assert got == bodies
    told = {'{"fraction":"0.5"}': (0.5, ""), '{"fraction":null}': (0.0, ""), '{"step":3}': (0.0, ""), '{"detail":7}': (0.0, "7")}
    frame = spark.createDataFrame([(b,) for b in told], "body string")
    assert {r.body: (r.fraction, r.detail) for r in tracking.normalise_progress(frame, source="stored").collect()} == told
    note = spark.createDataFrame([('{"step":10.0,"max_steps":20,"grad_norm":1}',)], "body string")
    assert tracking.normalise_progress(note).first().detail == "step=10.0/20  epoch=?  elapsed=?s  grad_norm=1.0000"


def test_eval_result_values(spark):
    frame = spark.createDataFrame([('{"valid_pct":"0.95","passed":1}',), ('{"valid_pct":1,"passed":null}',)], "body string")
    assert sorted((r.valid_pct, r.passed) for r in results.eval_results(frame).collect()) == [(0.95, True), (1.0, False)]
    for body in ('{"valid_pct":0.5}', '{"valid_pct":"x","passed":true}', "{broken"):
        with pytest.raises(Exception, match="eval result"):
            results.eval_results(spark.createDataFrame([(body,)], "body string")).collect()


def test_huge_weights(spark):
    frame = spark.createDataFrame([(1, 1.2e6), (2, 0.5)], "id long, weight double")
    drawn = resample.weighted_resample(frame, 1, "id", spread=False)
    assert abs(drawn.filter("id = 1").count() - 1_200_000) < 6000
    heavy = spark.createDataFrame([(1, 40000.0)], "id long, weight double")
    parts = resample.weighted_resample(heavy, 1, "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 3 and abs(sum(r["count"] for r in parts) - 40000) < 1500
