"""Answer parsing, repair, scoring and accuracy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.responses import parse_responses, repair_targets, safe_answers
from labelloom.operators import generate, quality, scoring
from labelloom.operators.labelling import with_prompt
from labelloom.plans import oracle as O
from labelloom.plans import oracle_made  # noqa: F401
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources import jsonl

ANSWER = ["answer.status", "answer.stat", "answer.action", "answer.target_object_id", "answer.confidence"]


def _answers(spark, sf):
    return parse_responses(V.raw_responses(spark, sf))


def _with_scenes(spark, sf):
    scenes = V.scenes(spark, sf).select("request_id", "objects")
    return _answers(spark, sf).join(scenes, "request_id")


@query("parse_responses", O.sql(["answers"], """
SELECT event_id, status, stat, action, target_object_id, confidence FROM answers"""))
def parse(spark, sf):
    return _answers(spark, sf).select("event_id", *ANSWER)


@query("repair_targets", O.sql(["repaired"], """
SELECT event_id, status, stat, action, target_object_id, confidence, repaired FROM repaired"""))
def repair(spark, sf):
    return repair_targets(_with_scenes(spark, sf)).select("event_id", *ANSWER, "answer.repaired")


@query("safe_infer", O.sql(["repaired"], """
SELECT event_id, CASE WHEN status LIKE 'ok%' THEN stat END AS stat, coalesce(action,'IDLE') AS action,
       CASE WHEN status LIKE 'ok%' THEN target_object_id END AS target_object_id,
       CASE WHEN status LIKE 'ok%' THEN confidence END AS confidence FROM repaired"""))
def safe_infer(spark, sf):
    return safe_answers(_with_scenes(spark, sf)).select("event_id", *ANSWER[1:])


@query("valid_rate", O.sql(["answers"], """
SELECT count(*)::BIGINT AS total, count_if(status LIKE 'ok%')::BIGINT AS valid,
       coalesce(count_if(status LIKE 'ok%')/nullif(count(*),0),0)::DOUBLE AS valid_pct,
       coalesce(count_if(status LIKE 'ok%')/nullif(count(*),0) >= 0.95, false) AS passed FROM answers"""))
def valid_rate(spark, sf):
    return quality.valid_rate(_answers(spark, sf).select("answer.status"))


@query("share_table", O.sql(["answers"], """
SELECT action, n AS count, printf('%.1f', n*100.0::DOUBLE/sum(n) OVER ()) AS pct,
       CASE WHEN n/sum(n) OVER () > 0.30 THEN 'DOMINANT' ELSE '' END AS flag FROM c""",
    c="SELECT action, count(*)::BIGINT AS n FROM answers WHERE action IS NOT NULL GROUP BY 1"))
def share_table(spark, sf):
    return quality.share_table(_answers(spark, sf).select("answer.action"), "action")


_PAIRS = "SELECT l.action AS expected, coalesce(a.action,'[INVALID]') AS predicted FROM labels l LEFT JOIN answers a USING (request_id)"


def _accuracy(spark, sf):
    predicted = _answers(spark, sf).select("request_id", F.col("answer.action").alias("predicted"))
    expected = V.labelled(spark, sf).select("request_id", F.col("label.action").alias("expected"))
    return quality.action_accuracy(predicted, expected, "request_id")


@query("action_accuracy", O.sql(["answers", "labels"], """
SELECT count(*)::BIGINT AS total, count_if(expected = predicted)::BIGINT AS correct,
       count_if(expected = predicted)/count(*)::DOUBLE AS accuracy FROM p""", p=_PAIRS))
def action_accuracy(spark, sf):
    return _accuracy(spark, sf)[0]


@query("action_accuracy_classes", O.sql(["answers", "labels"], """
SELECT predicted, count(*)::BIGINT AS n, count_if(expected = predicted)::BIGINT AS correct FROM p GROUP BY 1""", p=_PAIRS))
def action_accuracy_classes(spark, sf):
    return _accuracy(spark, sf)[1]


# -- scoring with a stand-in model -------------------------------------------


def make_prompt_reader():
    """Stand-in model: answers from the prompt text alone, and fails on some prompts."""
    import re

    first_action = {s: acts[0] for s, acts in C.STAT_ACTIONS.items()}
    types = C.STAT_TYPES
    highest = re.compile(r"(\w+)=[\d.]+ \(highest\)")
    objects = re.compile(r"(\w+)\(id=([^,]+),dist=")

    def answer(prompt: str) -> str:
        if len(prompt) % 13 == 0:
            raise RuntimeError("no answer")
        if len(prompt) % 11 == 0:
            return "no idea"
        stat = highest.search(prompt).group(1)
        scene = prompt.split(C.PROMPT_SCENE_HEAD, 1)[1].split("\n", 1)[0]
        fitting = [i for kind, i in objects.findall(scene) if kind in types[stat]]
        if types[stat] and not fitting:
            return '{"stat":"%s","action":"IDLE"}' % stat
        target = ',"target_object_id":"%s"' % fitting[0] if fitting else ""
        return 'Answer: {"stat":"%s","action":"%s"%s}' % (stat, first_action[stat], target)

    return scoring.one_by_one(answer)


@query("score_prompts", O.sql(["scored"], "SELECT request_id, raw FROM scored"))
def score_prompts(spark, sf):
    rows = V.examples(spark, sf).select("request_id", "prompt")
    return scoring.score_prompts(rows, make_prompt_reader).select("request_id", "raw")


@query("evaluate_model", O.sql(["scored"], """
SELECT count(*)::BIGINT AS total, sum(ok)::BIGINT AS valid, sum(ok)/count(*)::DOUBLE AS valid_pct, sum(ok)/count(*) >= 0.95 AS passed FROM j""",
    l="SELECT request_id % 50 AS kind, CASE WHEN raw IS NULL OR raw = 'no idea' THEN 0 ELSE 1 END AS ok FROM scored",
    j="SELECT CASE WHEN kind IN (3,4,6,7) THEN 0 ELSE ok END AS ok FROM l WHERE kind NOT IN (0,1,2,5)"))
def evaluate_model(spark, sf):
    """Scores the example lines; lines without a usable prompt get no valid answer."""
    marked = jsonl.mark_lines(V.stored_lines(spark, sf))
    return scoring.evaluate_model(marked, make_prompt_reader)[0]


# -- probe report ------------------------------------------------------------


def _judged(spark, sf):
    """Probes from one id per order, answered by the stand-in model."""
    asked = with_prompt(generate.make_probes(V.order_ids(spark, sf)), C.PROBE_SEED)
    return quality.judged(scoring.answer_requests(asked, make_prompt_reader))


def _section(kind, ok, total, threshold, empty="false"):
    return O.sql(["probe_judged"], f"""
SELECT correct, total, CASE WHEN total = 0 THEN 0.0 ELSE printf('%.4f', correct/total)::DOUBLE END AS accuracy,
       CASE WHEN total = 0 THEN {empty} ELSE correct/total >= {threshold} END AS passed FROM s""",
        s=f"SELECT count_if({ok})::BIGINT AS correct, count_if({total})::BIGINT AS total FROM probe_judged WHERE kind = '{kind}'")


@query("per_stat_accuracy", O.sql(["probe_judged"], """
SELECT stat, count_if(action_ok)::BIGINT AS correct, count(*)::BIGINT AS total,
       printf('%.4f', count_if(action_ok)/count(*))::DOUBLE AS accuracy, count_if(action_ok)/count(*) >= 0.90 AS passed
FROM probe_judged WHERE kind = 'stat' GROUP BY stat"""))
def per_stat_accuracy(spark, sf):
    return quality.per_stat_accuracy(_judged(spark, sf))


@query("target_accuracy", _section("stat", "target_ok", "target_counts", 0.90, "true"))
def target_accuracy(spark, sf):
    return quality.target_accuracy(_judged(spark, sf))


@query("conflict_accuracy", _section("conflict", "action_ok", "true", 0.80))
def conflict_accuracy(spark, sf):
    return quality.kind_accuracy(_judged(spark, sf), "conflict", C.CONFLICT_ACCURACY_PASS)


@query("fallback_accuracy", _section("absent", "action_ok", "true", 0.90))
def fallback_accuracy(spark, sf):
    return quality.kind_accuracy(_judged(spark, sf), "absent", C.FALLBACK_ACCURACY_PASS)


@query("action_share", O.sql(["probe_judged"], """
SELECT count(*)::BIGINT AS actions, sum(n)::BIGINT AS total, printf('%.4f', max(n)/sum(n))::DOUBLE AS max_share,
       max(n)/sum(n) <= 0.30 AS passed FROM c""",
    c="SELECT action, count(*) AS n FROM probe_judged WHERE kind = 'random' GROUP BY 1"))
def action_share(spark, sf):
    return quality.action_share(_judged(spark, sf))


def _report(spark, sf):
    return quality.quality_report(_judged(spark, sf))


_RATES = """SELECT count_if(kind='stat' AND target_ok)/nullif(count_if(kind='stat' AND target_counts),0) AS target,
  count_if(kind='conflict' AND action_ok)/nullif(count_if(kind='conflict'),0) AS conflict,
  count_if(kind='absent' AND action_ok)/nullif(count_if(kind='absent'),0) AS fallback FROM probe_judged"""
_SHARE = """SELECT max(n)/sum(n) AS share FROM (SELECT action, count(*) AS n FROM probe_judged WHERE kind = 'random' GROUP BY 1)"""
_STATS = """SELECT min(a) AS low, count(*) AS n FROM (
  SELECT stat, count_if(action_ok)/count(*) AS a FROM probe_judged WHERE kind = 'stat' GROUP BY 1)"""
_PASSED = """coalesce(low >= 0.90 AND n = 5, false) AS stats_passed, coalesce(target >= 0.90, true) AS target_passed,
  coalesce(conflict >= 0.80, false) AS conflict_passed, coalesce(fallback >= 0.90, false) AS fallback_passed"""
_FROM = "FROM r JOIN m ON true JOIN s ON true"
_PARTS = {"r": _RATES, "m": _SHARE, "s": _STATS}


@query("quality_report", O.sql(["probe_judged"], f"""
SELECT printf('%.4f', low)::DOUBLE AS lowest_stat, printf('%.4f', target)::DOUBLE AS target, printf('%.4f', conflict)::DOUBLE AS conflict,
       printf('%.4f', fallback)::DOUBLE AS fallback, printf('%.4f', share)::DOUBLE AS max_action_share,
       stats_passed AND target_passed AND conflict_passed AND fallback_passed AND share <= 0.30 AS passed
FROM (SELECT *, {_PASSED} {_FROM})""", **_PARTS))
def quality_report(spark, sf):
    """The nested report, read out into columns."""
    accuracy = F.transform(F.map_values("per_stat_accuracy"), lambda r: r["accuracy"])
    return _report(spark, sf).select(
        F.array_min(accuracy).alias("lowest_stat"),
        F.col("target_accuracy.accuracy").alias("target"),
        F.col("priority_conflict.accuracy").alias("conflict"),
        F.col("fallback_accuracy.accuracy").alias("fallback"),
        "max_action_share",
        F.col("pass").alias("passed"),
    )


@query("quality_report_json")
def quality_report_json(spark, sf):
    """The nested report as JSON text, one row."""
    report = _report(spark, sf)
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


@query("rename_nested", O.sql(["probe_judged"], f"""
SELECT {_PASSED}, false AS old_key_left {_FROM}""", **_PARTS))
def rename_nested(spark, sf):
    report = quality.rename_pass(_report(spark, sf))
    text = F.to_json(F.struct(*report.columns))
    return report.select(
        F.forall(F.map_values("per_stat_accuracy"), lambda r: r["passed"]).alias("stats_passed"),
        F.col("target_accuracy.passed").alias("target_passed"),
        F.col("priority_conflict.passed").alias("conflict_passed"),
        F.col("fallback_accuracy.passed").alias("fallback_passed"),
        F.contains(text, F.lit('"pass":')).alias("old_key_left"),
    )
