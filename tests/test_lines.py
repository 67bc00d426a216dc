"""JSONL scans and sink, validity, balance and weights."""

import json
from collections import Counter

import pytest

from labelloom.operators import quality, resample
from labelloom.sources import jsonl

GOOD = json.dumps({"prompt": "Stats: é → 1", "completion": '{"action":"EAT"}'}, ensure_ascii=False)
ODD = [
    (GOOD, True, True),
    ("  \t" + GOOD + " 　", True, True),
    (GOOD + " tail", False, False),
    (GOOD + "}", False, False),
    (GOOD + "," + GOOD, False, False),
    (GOOD + "],[" + GOOD, False, False),
    ('{"a":1}},{"v":{}', False, False),
    ("{bad", False, False),
    ("{'prompt':'Stats'}", False, False),
    ('{"prompt":"a\tb"}', False, False),
    ("[1]", True, False),
    ('"text"', True, False),
    ("null", True, False),
    ("3", True, False),
    ("'text'", False, False),
    ('{"prompt":5,"prompt":"Stats"}', True, True),
]


def text_file(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(tmp_path / name)


def test_line_marks(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(ODD)] + [(99, " \t"), (98, "")], "i int, value string")
    got = {r.i: r for r in jsonl.mark_lines(df).collect()}
    assert set(got) == set(range(len(ODD)))
    for i, (text, ok, is_object) in enumerate(ODD):
        assert (got[i].json_ok, got[i].is_object) == (ok, is_object), text
    assert got[15].prompt == "Stats" and got[0].prompt == "Stats: é → 1"


def test_strict_scan_names_the_line(spark, tmp_path):
    good = text_file(tmp_path, "good.jsonl", [GOOD, "", "  ", GOOD])
    assert jsonl.strict_examples(jsonl.read_lines(spark, good)).count() == 2
    bad = text_file(tmp_path, "bad.jsonl", [GOOD, "", "oops", GOOD])
    with pytest.raises(Exception, match=r"bad.jsonl:3: invalid JSON"):
        jsonl.strict_examples(jsonl.number_lines(jsonl.read_lines(spark, bad))).count()


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 5000), ("b.jsonl", 700)):
        text_file(tmp_path, name, [f"{name}-{i}-" + "x" * (i % 37) for i in range(1, n + 1)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path), glob="*.jsonl")
        assert lines.rdd.getNumPartitions() > 5
        rows = jsonl.number_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5700
    assert all(int(r.value.split("-")[1]) == r.line_no for r in rows)


def test_roundtrip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([('é → "q"\n\t', '{"action":"EAT"}'), ("", None)], jsonl.EXAMPLE_SCHEMA)
    jsonl.write_examples(df, str(tmp_path / "deep" / "out"))
    raw = "".join(p.read_text("utf-8") for p in (tmp_path / "deep" / "out").glob("part-*"))
    assert "é →" in raw
    back = spark.read.schema(jsonl.EXAMPLE_SCHEMA).json(str(tmp_path / "deep" / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_validity(spark):
    def line(prompt, completion):
        return json.dumps({"prompt": prompt, "completion": completion})

    cases = [
        (line("Stats", '{"action":"EAT"}'), True),
        (line("Stats", ' {"action":"EAT"} '), True),
        (line("none", '{"action":"EAT"}'), False),
        (line("Stats", '{"action":"FLY"}'), False),
        (line("Stats", '{"action":"EAT"} x'), False),
        (line("Stats", {"action": "EAT"}), False),
        (line("Stats", None), False),
        (json.dumps({"prompt": "Stats"}), False),
        ("[1]", False),
        ("oops", False),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, value string")
    checked = quality.with_validity(jsonl.mark_lines(df))
    assert {r.i: r.valid for r in checked.collect()} == {i: ok for i, (_, ok) in enumerate(cases)}
    assert tuple(quality.validity_counts(checked).first()) == (10, 2, 8)
    sample = quality.first_errors(checked, "i", 3).collect()
    assert [r.i for r in sample] == [2, 3, 4] and {r.more for r in sample} == {5}
    everything = quality.first_errors(checked, "i", 50).collect()
    assert len(everything) == 8 and {r.more for r in everything} == {0}


def classes(spark, counts):
    return spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "c string")


@pytest.mark.parametrize(
    "counts, passed, flags",
    [
        ({c: 100 for c in "ABCDE"}, True, {}),
        ({"A": 900, "B": 10, "C": 10, "D": 10, "E": 10}, False, {"A": "OVER", "B": "UNDER", "C": "UNDER", "D": "UNDER", "E": "UNDER"}),
        ({"A": 300, "B": 300, "C": 300, "D": 300, "E": 1}, False, {"E": "UNDER"}),
        ({"A": 2, "B": 3}, True, {}),
        ({}, True, {}),
    ],
)
def test_balance(spark, counts, passed, flags):
    balance = quality.class_balance(classes(spark, counts), "c")
    assert {r["class"]: r.flag for r in balance.collect() if r.flag} == flags
    assert quality.balance_gate(balance).first().passed is passed


def test_balance_can_raise(spark):
    quality.require_balance(quality.class_balance(classes(spark, {c: 100 for c in "ABCDE"}), "c"))
    skewed = quality.class_balance(classes(spark, {"A": 900, "B": 10, "C": 300, "D": 200, "E": 100}), "c")
    with pytest.raises(ValueError, match=r"A overrepresented \(59.6% > 25%\)\n  B underrepresented \(0.7% < 5%\)"):
        quality.require_balance(skewed)


def test_missing_class_is_only_seen_when_expected(spark):
    df = classes(spark, {c: 100 for c in "ABCDE"})
    balance = quality.class_balance(df, "c", expected_classes=list("ABCDEF"))
    assert {r["class"]: (r.n, r.flag) for r in balance.collect()}["F"] == (0, "UNDER")


def test_weights_sum_to_rows(spark):
    df = classes(spark, {"A": 300, "B": 20, "C": 1})
    rows = quality.class_weights(df, "c").collect()
    assert len(rows) == 321 and abs(sum(r.weight for r in rows) - 321) < 1e-9
    assert {r.c: r.weight for r in rows}["C"] == pytest.approx(107.0)


def test_lookup_join_past_its_bound(spark):
    from labelloom.operators.lookup import join_lookup

    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    small = spark.range(500).selectExpr("id as k", "id * 2 as v")
    want = sorted(map(tuple, join_lookup(big, small, "k").collect()), key=str)
    got = sorted(map(tuple, join_lookup(big, small, "k", max_rows=10).collect()), key=str)
    assert got == want and len(got) == 1000


@pytest.mark.parametrize("spread", [False, True])
def test_resample_evens_out_classes(spark, spread):
    df = spark.range(4000).selectExpr("id", "case when id % 20 = 0 then 'rare' when id % 3 = 0 then 'mid' else 'many' end as c")
    drawn = resample.weighted_resample(quality.class_weights(df, "c"), 1, "id", spread=spread)
    counts = Counter(r.c for r in drawn.select("c").collect())
    assert sum(counts.values()) == pytest.approx(4000, rel=0.06)
    assert all(n == pytest.approx(4000 / 3, rel=0.12) for n in counts.values())
    heavy = spark.createDataFrame([(1, 5000.0), (2, 0.0)], "id bigint, weight double")
    copies = Counter(r.id for r in resample.weighted_resample(heavy, 1, "id", spread=spread).collect())
    assert copies[1] == pytest.approx(5000, rel=0.06) and copies[2] == 0
