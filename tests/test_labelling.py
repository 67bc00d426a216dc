"""Rule labels, prompts and row checks on hand-made requests."""

import pytest
from plans import plan_text

from labelloom.functions import constants as C
from labelloom.functions.scenes import OBJECTS_TYPE
from labelloom.operators import labelling

STATS_TYPE = "struct<" + ",".join(f"{s}:double" for s in C.PROMPT_STATS) + ">"
SCHEMA = f"request_id bigint, stats {STATS_TYPE}, objects {OBJECTS_TYPE}, tick bigint"


def request(objects=(), tick=0, key=0, **stats):
    values = {s: 0.1 for s in C.PROMPT_STATS} | stats
    return (key, tuple(values[s] for s in C.PROMPT_STATS), [tuple(o) for o in objects], tick)


def label_of(spark, *args, seed=None, **kw):
    df = spark.createDataFrame([request(*args, **kw)], SCHEMA)
    return labelling.label_requests(df, seed).select("label.*").first()


@pytest.mark.parametrize(
    "objects, tick, stats, action, target, confidence",
    [
        ([("far", "bowl", 9.0), ("near", "bowl", 2.0)], 0, {"hunger": 0.9}, "EAT", "near", 0.9),
        ([("toy", "toy", 1.0), ("bowl", "bowl", 8.0)], 0, {"hunger": 0.9}, "EAT", "bowl", 0.9),
        ([("a", "bowl", 2.0), ("b", "bowl", 2.0)], 0, {"hunger": 0.9}, "EAT", "a", 0.9),
        ([("p", "player", 5.0), ("q", "pet", 4.0)], 0, {"social": 0.8}, "SOCIAL", "q", 0.8),
        ([("b", "bed", 5.0)], 0, {"tiredness": 0.7}, "SLEEP", "b", 0.7),
        ([("t", "toy", 5.0)], 0, {"boredom": 0.7}, "PLAY", "t", 0.7),
        ([("b", "bowl", 1.0)], 3, {"toilet": 0.95}, "TOILET", None, 0.95),
        ([("t", "toy", 1.0)], 2, {"hunger": 0.9}, "IDLE", None, 0.9),
        ([("t", "toy", 1.0)], 3, {"hunger": 0.9}, "EXPLORE", None, 0.9),
        ([], 2, {"hunger": 0.49}, "IDLE", None, 0.51),
        ([], 3, {}, "EXPLORE", None, 0.9),
        ([], -3, {}, "EXPLORE", None, 0.9),
    ],
)
def test_rule(spark, objects, tick, stats, action, target, confidence):
    row = label_of(spark, objects, tick, **stats)
    assert (row.action, row.target_object_id, row.confidence) == (action, target, confidence)


def test_equal_stats_follow_the_label_order(spark):
    assert label_of(spark, boredom=0.8, tiredness=0.8).stat == "tiredness"


def test_prompt_breaks_the_same_tie_its_own_way(spark):
    df = spark.createDataFrame([request(boredom=0.8, tiredness=0.8)], SCHEMA)
    text = labelling.with_prompt(df).first().prompt
    assert "boredom=0.80 (highest), tiredness=0.80" in text


def test_seeded_labels_reach_both_actions_and_repeat(spark):
    rows = [request([("b", "bowl", 1.0)], hunger=0.9, key=i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: [r.action for r in labelling.label_requests(df, 7).select("label.action").collect()]
    first = run()
    assert set(first) == {"EAT", "DRINK"} and first == run()


def test_prompt_text(spark):
    objects = [("far", "bowl", 9.25), ("near", "toy", 1.0)]
    text = labelling.with_prompt(spark.createDataFrame([request(objects, hunger=0.125, key=5)], SCHEMA)).first().prompt
    lines = text.split("\n")
    assert lines[1] == "Stats (highest first): hunger=0.12 (highest), boredom=0.10, social=0.10, toilet=0.10, tiredness=0.10"
    assert lines[4] == "Scene (nearest first): toy(id=near,dist=1.0), bowl(id=far,dist=9.2)"
    assert sorted(lines[5].removeprefix("Available actions: ").split(", ")) == sorted(
        ["EAT", "DRINK", "PLAY", "FETCH", "TOILET", "IDLE", "EXPLORE"]
    )
    assert lines[6] == "Respond with JSON only." and len(text) < 1200


def test_empty_scene(spark):
    text = labelling.with_prompt(spark.createDataFrame([request()], SCHEMA)).first().prompt
    assert "Scene (nearest first): empty\n" in text


def test_labels_and_prompts_are_narrow_and_native(spark):
    nested = spark.createDataFrame([request(key=1)], SCHEMA)
    plan = plan_text(labelling.render_examples(labelling.label_requests(nested)))
    assert "Exchange" not in plan and "Python" not in plan


def test_flat_and_nested_labels_agree(spark):
    rows = [
        request([("a", "bowl", 3.0), ("b", "bowl", 3.0), ("c", "toy", 1.0)], hunger=0.9, key=1),
        request([("a", "toy", 3.0)], hunger=0.9, tick=1, key=2),
        request([], toilet=0.9, key=3),
        request([], key=4, tick=1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    flat = df.selectExpr("request_id", "posexplode(objects) as (pos, o)").selectExpr("request_id", "pos", "o.*")
    got = labelling.label_flat(df, labelling.nearest_by_stat(flat, ["pos"]))
    want = labelling.label_requests(df).select("request_id", "label.*")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_request_violations(spark):
    bad = [
        (1, (1.5, 0.1, 0.1, 0.1, None), [("a", "ball", 1.0)], None),
        (2, (float("nan"), 0.0, 1.0, 0.1, -0.1), [("a", "bowl", 1.0)], 1),
        (3, (0.5, 0.0, 1.0, 0.1, 0.1), [("a", "bowl", -5.0)], 1),
    ]
    rows = spark.createDataFrame(bad, SCHEMA).selectExpr("request_id", f"{labelling.request_violations()} as v").collect()
    assert {r.request_id: r.v for r in rows} == {
        1: ["range:hunger", "range:tiredness", "required:tick", "enum:object"],
        2: ["range:hunger", "range:tiredness"],
        3: [],
    }
