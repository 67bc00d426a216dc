"""Answer parsing, target repair and scoring."""

import os

import pytest
from plans import plan_text

from labelloom.functions.responses import parse_responses, repair_targets, safe_answers
from labelloom.functions.scenes import OBJECTS_TYPE
from labelloom.operators import scoring
from labelloom.sources.jsonl import mark_lines

CASES = [
    ('{"action": "IDLE"}', "ok", "IDLE", None, None),
    ('{"action": "EAT", "target_object_id": "b1", "confidence": 0.9}', "ok", "EAT", "b1", 0.9),
    ('Well: {"action": "EXPLORE"} so there', "ok", "EXPLORE", None, None),
    ('{"action":\n "SLEEP"}', "ok", "SLEEP", None, None),
    ("{action: IDLE}", "bad_json", None, None, None),
    ("{'action': 'IDLE'}", "bad_json", None, None, None),
    ('{"target_object_id": "b1"}', "bad_schema", None, None, None),
    ("I do not know.", "no_json", None, None, None),
    ("", "no_json", None, None, None),
    (None, "no_json", None, None, None),
    ('{"action": "DANCE"}', "bad_schema", None, None, None),
    ('{"action":"EAT","target_object_id":"b1","confidence":0.9,"confidence":0.', "ok_truncated", "EAT", "b1", None),
    ('{"action":"SLEEP","confidence":0.85,"conf', "ok_truncated", "SLEEP", None, None),
    ('{"target_object_id":"b1","confidence":0.9,"c', "no_json", None, None, None),
    ('{"action":"DANCE","confi', "bad_partial", None, None, None),
    ('{"a":{"b":1},"action":"EAT"}', "bad_schema", None, None, None),
    ('{"action":"EAT"} {"action":"IDLE"}', "ok", "EAT", None, None),
    ('{} "action": "EAT"', "bad_schema", None, None, None),
    ('{"action":"EAT","action":"IDLE"}', "ok", "IDLE", None, None),
    ('{"action":"EAT","target_object_id":5}', "bad_schema", None, None, None),
    ('{"action":"EAT","stat":7}', "bad_schema", None, None, None),
    ('{"action":"EAT","confidence":"0.5"}', "ok", "EAT", None, 0.5),
    ('{"action":"EAT","confidence":true}', "ok", "EAT", None, 1.0),
    ('{"action":"EAT","confidence":"1d"}', "bad_schema", None, None, None),
    ('{"action":"EAT","confidence":[1]}', "bad_schema", None, None, None),
    ('{"action":"EAT","confidence":null,"stat":null}', "ok", "EAT", None, None),
]


def test_parser_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    parsed = parse_responses(df)
    assert "Python" not in plan_text(parsed) and "Exchange" not in plan_text(parsed)
    got = {r.i: r.answer for r in parsed.collect()}
    for i, (raw, *want) in enumerate(CASES):
        a = got[i]
        assert [a.status, a.action, a.target_object_id, a.confidence] == want, raw


REPAIRS = [
    ("EAT", None, [("far", "bowl", 20.0), ("near", "bowl", 3.0)], "near", True),
    ("EAT", "b", [("a", "bowl", 1.0), ("b", "bowl", 5.0)], "b", False),
    ("EAT", None, [("t", "toy", 1.0), ("b", "bowl", 15.0)], "b", True),
    ("IDLE", None, [("b", "bowl", 1.0)], None, False),
    ("TOILET", "ghost", [("b", "bowl", 1.0)], "ghost", False),
    ("EAT", "ghost", [("t", "toy", 1.0)], "ghost", False),
    ("SOCIAL", None, [("p", "player", 30.0), ("q", "pet", 5.0)], "q", True),
    ("EAT", "t", [("t", "toy", 1.0), ("b", "bowl", 5.0)], "b", True),
    ("EAT", "ghost", [("b", "bowl", 8.0)], "b", True),
    ("FETCH", None, [("x", "toy", 2.0), ("y", "toy", 2.0)], "x", True),
    ("EAT", None, [], None, False),
]


def test_repairs(spark):
    kind = "struct<status:string,stat:string,action:string,target_object_id:string,confidence:double>"
    rows = [(i, ("ok", "hunger", a, t, 0.85), objs) for i, (a, t, objs, _, _) in enumerate(REPAIRS)]
    df = spark.createDataFrame(rows, f"i int, answer {kind}, objects {OBJECTS_TYPE}")
    got = {r.i: r.answer for r in repair_targets(df).collect()}
    for i, (_, _, _, target, repaired) in enumerate(REPAIRS):
        assert (got[i].target_object_id, got[i].repaired) == (target, repaired), i
        assert got[i].confidence == 0.85
        assert got[i].stat == (None if repaired else "hunger")


def test_failures_become_idle(spark):
    df = spark.createDataFrame([("no", []), ('{"action":"EAT"}', [("b", "bowl", 1.0)])], f"raw string, objects {OBJECTS_TYPE}")
    idle, eat = [r.answer for r in safe_answers(parse_responses(df)).collect()]
    assert (idle.action, idle.target_object_id, idle.confidence) == ("IDLE", None, None)
    assert (eat.action, eat.target_object_id) == ("EAT", "b")


@pytest.mark.parametrize("text, pct, passed", [('{"action":"IDLE"}', 1.0, True), ("nothing", 0.0, False)])
def test_evaluate(spark, text, pct, passed):
    lines = ['{"prompt":"Stats a","completion":"x"}', "{bad", "", "[1]", '{"completion":"x"}']
    marked = mark_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    make = lambda: scoring.one_by_one(lambda prompt: text)
    row = scoring.evaluate_model(marked, make)[0].first()
    assert row.total == 3 and row.valid == round(pct * 2)
    assert row.passed is (passed and row.valid_pct >= 0.95)


def test_no_rows_fail(spark):
    from labelloom.operators.quality import valid_rate

    row = valid_rate(spark.createDataFrame([], "status string")).first()
    assert (row.total, row.valid, row.valid_pct, row.passed) == (0, 0, 0.0, False)


def test_model_is_made_once_per_task_and_failures_are_contained(spark):
    def make():
        def answer(prompt):
            if prompt == "p3":
                raise ValueError("boom")
            return prompt.upper()

        return scoring.one_by_one(answer)

    df = spark.createDataFrame([(f"p{i}",) for i in range(5)], "prompt string")
    got = {r.prompt: r.raw for r in scoring.score_prompts(df, make).collect()}
    assert got == {"p0": "P0", "p1": "P1", "p2": "P2", "p3": None, "p4": "P4"}


def test_strict_answers_stop_at_the_first_bad_one(spark):
    df = spark.createDataFrame([("good", [("b", "bowl", 1.0)])], f"prompt string, objects {OBJECTS_TYPE}")
    good = scoring.answer_requests(df, lambda: scoring.one_by_one(lambda p: '{"action":"EAT"}'), strict=True)
    assert (good.first().answer.action, good.first().answer.target_object_id) == ("EAT", None)
    bad = scoring.answer_requests(df, lambda: scoring.one_by_one(lambda p: "oops"), strict=True)
    with pytest.raises(Exception, match="invalid response: oops"):
        bad.collect()


def test_a_model_is_loaded_once_per_process(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda prompts: [f"{os.getpid()}" for _ in prompts]

    rows = spark.range(4000).selectExpr("cast(id as string) as prompt").repartition(40)
    pids = set()
    for _ in range(2):  # a second job finds the models of the first
        pids |= {r["raw"] for r in scoring.score_prompts(rows, make).select("raw").distinct().collect()}
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert sorted(loads) == sorted(pids) and len(loads) < 40


def test_kept_models_are_few():
    made = []
    for token in ("a", "b", "a", "c", "a", "b"):
        scoring.kept_model(token, lambda token=token: made.append(token) or list)
    assert made == ["a", "b", "c", "b"] and len(scoring._models) == scoring.MODELS_KEPT


def test_a_user_tokenizer_gets_bounded_slices(spark):
    from labelloom.operators import tokens

    def make():
        def encode(texts, special):
            size = sum(map(len, texts))
            assert len(texts) <= 512 and (size <= 1 << 20 or len(texts) == 1), (len(texts), size)
            return [[1] * special + [len(t)] * 600 for t in texts]

        return encode

    rows = spark.range(0, 3000, 1, 1).selectExpr(
        "id", "repeat('p', int(if(id = 5, 2000000, id))) as prompt", "repeat('c', int(if(id % 500 = 0, 300000, 1))) as completion", "'x' as input_ids"
    )
    out = tokens.tokenise(rows, make, max_length=4)
    assert out.columns == ["id", "prompt", "completion", "input_ids", "prompt_ids"]
    got = {r.id: (r.input_ids, r.prompt_ids) for r in out.select("id", "input_ids", "prompt_ids").collect()}
    want = {i: (2000000 if i == 5 else i, 300000 if i % 500 == 0 else 1) for i in range(3000)}
    assert got == {i: ([1] + [p + c] * 3, [p] * 4) for i, (p, c) in want.items()}
