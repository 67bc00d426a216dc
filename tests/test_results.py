"""Per-run files."""

import json

from labelloom.operators import quality, tracking
from labelloom.sources import results

SECTION = {"correct": 38, "total": 40, "accuracy": 0.95, "passed": True}
STATS = ["hunger", "tiredness", "boredom", "social", "toilet"]
REPORT = {
    "per_stat_accuracy": {s: SECTION for s in STATS},
    "target_accuracy": SECTION, "priority_conflict": SECTION, "fallback_accuracy": SECTION,
    "action_distribution": {"EAT": 3}, "max_action_share": 0.2, "passed": True,
}


def put(root, run, name, text):
    (root / run).mkdir(exist_ok=True)
    (root / run / name).write_text(text)


def test_reports(spark, tmp_path):
    put(tmp_path, "good", "report.json", json.dumps(REPORT, indent=1))
    put(tmp_path, "broken", "report.json", "{oops")
    put(tmp_path, "tail", "report.json", json.dumps(REPORT) + "x")
    put(tmp_path, "missing", "report.json", json.dumps(REPORT | {"per_stat_accuracy": {s: SECTION for s in STATS[1:]}}))
    put(tmp_path, "range", "report.json", json.dumps(REPORT | {"target_accuracy": SECTION | {"accuracy": 1.5}}))
    put(tmp_path, "other", "else.json", json.dumps(REPORT))
    rows = quality.read_reports(results.read_run_texts(spark, str(tmp_path), "report.json")).collect()
    got = {r.run_id: r.report for r in rows}
    assert set(got) == {"good", "broken", "tail", "missing", "range"}
    assert [k for k, v in got.items() if v is not None] == ["good"]
    assert got["good"].per_stat_accuracy["hunger"].correct == 38


def test_a_file_per_run_costs_no_task_per_run(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('run_id=', id % 100) as run", "if(id = 7, null, concat('line ', id, '\u00e9')) as value", "id")
    placed = rows.repartition(3, "run").sortWithinPartitions("run", "id").select("run", "value")
    assert results.write_run_files(placed, str(tmp_path), "report.json") == 100
    texts = results.read_run_texts(spark, str(tmp_path), "report.json", grouped=True)
    assert texts.rdd.getNumPartitions() <= results.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    got = {r.run_id: r.body for r in texts.collect()}
    want = {f"run_id={k}": "".join(f"{'line ' + str(i) + chr(233) if i != 7 else ''}\n" for i in range(k, 400, 100)) for k in range(100)}
    assert got == want
    assert results.write_run_files(placed.limit(0), str(tmp_path / "none"), "report.json") == 0
    assert results.read_run_texts(spark, str(tmp_path / "none"), "report.json", grouped=True).count() == 0


def test_progress_files_and_logs(spark, tmp_path):
    put(tmp_path, "r1", "progress.json", '{\n "fraction": 0.5,\n "detail": "half"\n}')
    put(tmp_path, "r2", "progress.json", "")
    put(tmp_path, "r1", "logs.txt", "a\nb\nc\n")
    put(tmp_path, "r2", "logs.txt", "x\n")
    rows = tracking.normalise_progress(results.read_run_texts(spark, str(tmp_path), "progress.json")).collect()
    got = {r.run_id: (r.fraction, r.detail) for r in rows}
    assert got["r1"] == (0.5, "half") and got.get("r2", (0.0, "")) == (0.0, "")
    logs = results.read_run_logs(spark, str(tmp_path), "logs.txt").collect()
    assert sorted((r.run_id, r.line_no, r.line) for r in logs) == [("r1", 1, "a"), ("r1", 2, "b"), ("r1", 3, "c"), ("r2", 1, "x")]


def test_eval_results_and_report_sink(spark, tmp_path):
    path = str(tmp_path / "evals.json")
    (tmp_path / "evals.json").write_text('{"run_id":"r","valid_pct":1,"passed":true}\n')
    assert tuple(results.read_eval_results(spark, path).first()) == ("r", 1.0, True)
    report = spark.createDataFrame([(0.5, {"EAT": 1})], "max_action_share double, action_distribution map<string,bigint>")
    results.write_report(report, str(tmp_path / "deep" / "report"))
    back = spark.read.schema(report.schema).json(str(tmp_path / "deep" / "report")).first()
    assert (back.max_action_share, back.action_distribution) == (0.5, {"EAT": 1})
