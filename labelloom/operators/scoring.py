"""Scoring with a user model inside Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.responses import is_ok, parse_responses, safe_answers
from labelloom.operators.quality import valid_rate
from labelloom.sources.session import settled, ship_package

Scorer = Callable[[list[str]], list[str | None]]


def one_by_one(answer: Callable[[str], str]) -> Scorer:
    """Batch scorer from a function of one prompt; a failing prompt has no answer."""

    def score(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for prompt in prompts:
            try:
                out.append(answer(prompt))
            except Exception:  # noqa: BLE001
                out.append(None)
        return out

    return score


# Models of this worker process, newest last; a worker outlives its tasks.
_models: dict[str, Scorer] = {}
MODELS_KEPT = 2


def kept_model(token: str, make_scorer: Callable[[], Scorer]) -> Scorer:
    """The scorer of a factory, made once per worker process."""
    if token in _models:
        _models[token] = _models.pop(token)
    else:
        while len(_models) >= MODELS_KEPT:
            _models.pop(next(iter(_models)))
        _models[token] = make_scorer()
    return _models[token]


def score_prompts(df: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt", into: str = "raw") -> DataFrame:
    """Add the raw model text; only prompts reach Python.

    The model is made once per worker process and kept for later tasks, under the digest of
    its factory and what that captures; so a changed factory gets a model of its own.
    """
    ship_package(df.sparkSession)
    token = hashlib.sha256(cloudpickle.dumps(make_scorer)).hexdigest()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept_model(token, make_scorer)
        for prompts in batches:
            yield pd.Series(scorer(prompts.tolist()), dtype=object)

    return df.withColumn(into, F.pandas_udf(run, "string")(F.col(prompt)))


def evaluate_model(marked: DataFrame, make_scorer: Callable[[], Scorer]) -> tuple[DataFrame, DataFrame]:
    """Valid-answer rate, and counts ``n`` per status and action, over rows from ``mark_lines``.

    Lines that are not JSON are left out; JSON that is no object counts as invalid. Answers
    are counted as they are made; only the few counts are stored, and both tables come from them.
    """
    rows = marked.filter("json_ok").select("is_object", F.coalesce("prompt", F.lit("")).alias("prompt"))
    parsed = parse_responses(score_prompts(rows, make_scorer))
    status = F.when(F.col("is_object"), F.col("answer.status")).otherwise("bad_line")
    action = F.when(F.col("is_object"), F.col("answer.action"))
    cells = settled(
        parsed.groupBy(status.alias("status"), action.alias("action")).agg(F.count(F.lit(1)).alias("n"))
    )
    return valid_rate(cells, held=F.col("n")), cells


def answer_requests(df: DataFrame, make_scorer: Callable[[], Scorer], strict: bool = False) -> DataFrame:
    """Answers for requests that carry prompt and objects.

    By default targets are repaired and failures become the idle answer. Strict answers
    are taken as parsed, and the first one that is not valid stops the job.
    """
    parsed = parse_responses(score_prompts(df, make_scorer))
    if not strict:
        return safe_answers(parsed)
    stop = F.raise_error(F.concat(F.lit("invalid response: "), F.coalesce("raw", F.lit("none")))).cast("string")
    action = F.when(is_ok(F.col("answer.status")), F.col("answer.action")).otherwise(stop)
    return parsed.withColumn("answer", F.col("answer").withField("action", action))
