"""Generated data: counts, ranges, labels, whole job, probes and report."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.operators import generate, quality, tokens


@pytest.fixture(scope="module")
def made(spark):
    return generate.make_requests(spark.range(2000).withColumnRenamed("id", "request_id")).collect()


def test_strata_are_exact(spark):
    counts = generate.stratify(spark.range(503).withColumnRenamed("id", "request_id")).groupBy("dominant").count()
    assert {r.dominant: r["count"] for r in counts.collect()} == {
        "hunger": 101, "tiredness": 101, "boredom": 101, "social": 100, "toilet": 100
    }


def test_stats(made):
    clashes = [r for r in made if r.second]
    assert 0.12 < len(clashes) / len(made) < 0.18
    for r in made:
        for name in C.LABEL_STATS:
            low, high = (0.0, 0.35)
            if name == r.dominant:
                low, high = (0.80, 1.0) if r.second else (0.70, 1.0)
            elif name == r.second:
                low, high = (0.60, 0.79)
            assert low <= r.stats[name] <= high


def test_scenes(made):
    present = [r for r in made if r.dominant != "toilet" and r.present]
    assert 0.70 < len(present) / sum(r.dominant != "toilet" for r in made) < 0.80
    sizes = set()
    for r in made:
        needed = C.STAT_TYPES[r.dominant]
        fitting = [o for o in r.objects if o.type in needed]
        assert 0 <= r.tick <= 10_000 and len({o.id for o in r.objects}) == len(r.objects)
        assert all(1.0 <= o.distance <= 50.0 and round(o.distance, 1) == o.distance for o in r.objects)
        if r.dominant == "toilet":
            assert r.present and len(r.objects) <= 3
        elif r.present:
            assert 2 <= len(fitting) and len(r.objects) <= 7
        else:
            assert not fitting and len(r.objects) <= 5
        sizes.add(len(r.objects))
    assert sizes == set(range(8))


def test_rows_do_not_depend_on_their_partition(spark):
    ids = spark.range(300).withColumnRenamed("id", "request_id")
    a = generate.make_examples(ids.repartition(7)).select("request_id", "prompt", "completion")
    b = generate.make_examples(ids.coalesce(1)).select("request_id", "prompt", "completion")
    assert sorted(a.collect()) == sorted(b.collect())


def test_whole_job(spark, tmp_path):
    ids = lambda n: spark.range(n).withColumnRenamed("id", "request_id")
    rows = {r.split: r for r in generate.generate_dataset({"train": ids(1000), "eval": ids(200)}, str(tmp_path)).collect()}
    assert (rows["train"].total, rows["train"].invalid, rows["eval"].total) == (1000, 0, 200)
    assert rows["train"].over == 0 and rows["train"].classes == 10
    lines = {p: [line for f in (tmp_path / p).glob("part-*") for line in f.read_text().splitlines()] for p in ("train", "eval")}
    assert len(lines["train"]) == 1000 and not set(lines["train"]) & set(lines["eval"])


def probes(spark, n=2200):
    return generate.make_probes(spark.range(n).withColumnRenamed("id", "request_id"))


def test_probe_kinds(spark):
    rows = probes(spark).collect()
    assert Counter(r.kind for r in rows) == {"stat": 1000, "conflict": 100, "absent": 100, "random": 1000}
    for r in rows:
        if r.kind == "stat":
            assert r.stats[r.stat] == 0.9 and sorted(r.stats)[:4] == [0.1] * 4
            if r.stat != "toilet":
                fitting = [o for o in r.objects if o.type in C.STAT_TYPES[r.stat]]
                assert len(fitting) == 3 and min(fitting, key=lambda o: o.distance).id == "target_0" == r.expected_target
            else:
                assert r.objects == [] and r.expected_target is None
        elif r.kind == "conflict":
            assert r.stat != r.second and r.stats[r.stat] >= 0.85 > r.stats[r.second] >= 0.6
        elif r.kind == "absent":
            assert 1 <= len(r.objects) <= 4 and not [o for o in r.objects if o.type in C.STAT_TYPES[r.stat]]
            assert r.expected_actions == ["IDLE", "EXPLORE"]


def answered(df, action, target=None):
    answer = F.struct(action.alias("action"), (F.lit(None).cast("string") if target is None else target).alias("target_object_id"))
    return quality.judged(df.withColumn("answer", answer))


def test_report_of_a_perfect_model(spark):
    from labelloom.operators.labelling import label_requests

    rows = label_requests(probes(spark))
    judged = answered(rows, F.col("label.action"), F.col("label.target_object_id"))
    report = quality.quality_report(judged).first()
    assert report["pass"] and all(v["accuracy"] == 1.0 for v in report.per_stat_accuracy.values())
    assert (report.target_accuracy.total, report.target_accuracy.accuracy) == (800, 1.0)
    assert report.priority_conflict.accuracy == 1.0 and report.fallback_accuracy.accuracy == 1.0
    assert sum(report.action_distribution.values()) == 1000
    renamed = quality.rename_pass(quality.quality_report(judged)).first()
    assert renamed.passed and renamed.target_accuracy.passed and renamed.per_stat_accuracy["hunger"].passed


def test_report_of_an_idle_model(spark):
    report = quality.quality_report(answered(probes(spark), F.lit("IDLE"))).first()
    assert not report["pass"] and report.max_action_share == 1.0
    assert report.target_accuracy["pass"] and report.target_accuracy.total == 0
    assert report.fallback_accuracy["pass"] and not report.priority_conflict["pass"]


def test_report_without_probes(spark):
    report = quality.quality_report(answered(probes(spark, 0), F.lit("IDLE"))).first()
    assert not report["pass"] and report.max_action_share == 0.0


def test_masks(spark):
    rows = [([1, 5, 6, 7], [5, 6]), ([1, 5], [5]), ([1, 5, 6], [5, 6, 7, 8]), ([1, 9], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, input_ids array<int>, prompt_ids array<int>")
    got = {r.i: (r.labels, r.attention_mask) for r in tokens.mask_labels(df).collect()}
    assert got == {0: ([-100, -100, -100, 7], [1] * 4), 3: ([-100, 9], [1, 1])}


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([("a " * 10, "b " * 600), ("a " * 600, "b")], "prompt string, completion string")
    rows = tokens.mask_labels(tokens.tokenise_words(df)).collect()
    assert len(rows) == 1 and len(rows[0].input_ids) == 512 and rows[0].labels[:11] == [-100] * 11
