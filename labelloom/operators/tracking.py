"""Run tracking: states, progress snapshots, logs, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.jsontext import parse_objects
from labelloom.functions.text import fixed, stripped

SNAPSHOT_FIELDS = ["fraction", "detail", "step", "max_steps", "epoch", "elapsed_s", *C.NOTEBOOK_METRICS]


def mapped_state(raw: Column, states: dict[str, str | None]) -> Column:
    """State by exact name; unknown and undecided names are pending."""
    entries: list[Column] = []
    for name, state in states.items():
        if state is not None:
            entries += [F.lit(name), F.lit(state)]
    return F.coalesce(F.element_at(F.create_map(*entries), raw), F.lit("pending"))


def keyword_state(text: Column, keywords: list[tuple[str, str]] = C.KEYWORD_STATES) -> Column:
    """State of the first keyword, in declared order, that the text contains."""
    low = F.lower(text)
    first, *rest = keywords
    out = F.when(F.contains(low, F.lit(first[0])), first[1])
    for word, state in rest:
        out = out.when(F.contains(low, F.lit(word)), state)
    return out.otherwise("pending")


def file_state(text: Column) -> Column:
    """State from a status file read case-insensitively; anything else is pending."""
    word = F.lower(stripped(text))
    return F.when(word.isin(C.JOB_STATES), word).otherwise("pending")


def resolved_state(status_file: Column, api_state: Column) -> Column:
    """The status file if it holds a legal state, else the mapped API state, else pending."""
    word = stripped(status_file)
    return F.coalesce(F.when(word.isin(C.JOB_STATES), word), api_state, F.lit("pending"))


def session_state(alive: Column, has_checkpoint: Column) -> Column:
    return F.when(alive, "running").when(has_checkpoint, "done").otherwise("failed")


def backend_of(run_id: Column) -> Column:
    head = F.split_part(run_id, F.lit("/"), F.lit(1))
    known = F.contains(run_id, F.lit("/")) & head.isin(C.BACKENDS)
    return F.when(known, head).otherwise("")


def artifact_key(name: Column, run_id: Column, model_id: Column, path: Column) -> Column:
    """Storage key by the first known of name, run, model; always ends in .gz."""
    def filled(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    key = (
        F.when(filled(name), F.concat(F.lit("gguf/"), name, F.lit(".gguf")))
        .when(filled(run_id), F.concat(F.lit("workflow/"), run_id, F.lit("/model.gguf")))
        .when(filled(model_id), F.concat(F.lit("gguf/"), model_id, F.lit(".gguf")))
        .otherwise(path)
    )
    return F.when(F.endswith(key, F.lit(".gz")), key).otherwise(F.concat(key, F.lit(".gz")))


def _kind(value: Column) -> Column:
    """Kind of a JSON value: NUMBER, STRING, VOID (a JSON null) or another; null without a value."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "NUMBER").otherwise(kind)


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _shown(value: Column, default: str) -> Column:
    """Text of a JSON value: whole numbers without a point, null as None, ``default`` without a value."""
    text = (
        F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("string"))
        .when(_kind(value) == "NUMBER", _number(value).cast("string"))
        .when(_kind(value) == "VOID", "None")
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
    return F.when(value.isNull(), default).otherwise(text)


def normalise_progress(snapshots: DataFrame, body: str = "body", source: str = "notebook") -> DataFrame:
    """Add fraction and detail from a snapshot; unreadable text is (0.0, '').

    ``source`` says what the text is built from: ``notebook`` shows step, epoch, elapsed
    time and three metrics, ``host`` epoch and two metrics, ``stored`` holds fraction and
    detail. A body with one of these two and no step counts is read as ``stored`` too.
    A missing step is 0 of 1; a metric or step that is there but no number makes the body
    unreadable.
    """
    parsed = parse_objects(snapshots, F.col(body), SNAPSHOT_FIELDS, "_s")
    s = {n: F.col(f"_s_fields.{n}") for n in SNAPSHOT_FIELDS}
    has = {n: s[n].isNotNull() for n in SNAPSHOT_FIELDS}
    wrong = lambda n: has[n] & (_kind(s[n]) != "NUMBER")
    counted = F.lit(source != "stored") & (has["step"] | has["max_steps"] | ~(has["fraction"] | has["detail"]))
    metrics = C.NOTEBOOK_METRICS if source == "notebook" else C.HOST_METRICS
    parts = [F.concat(F.lit("epoch="), _shown(s["epoch"], "?"))]
    if source == "notebook":
        place = F.concat(F.lit("step="), _shown(s["step"], "0"), F.lit("/"), _shown(s["max_steps"], "1"))
        parts = [place, *parts, F.concat(F.lit("elapsed="), _shown(s["elapsed_s"], "?"), F.lit("s"))]
    parts += [F.when(has[m], F.concat(F.lit(f"{m}="), fixed(_number(s[m]), 4))) for m in metrics]
    no_steps = has["max_steps"] & (F.coalesce(_number(s["max_steps"]), F.lit(0.0)) == 0) & (
        (_kind(s["max_steps"]) == "NUMBER") | (_kind(s["max_steps"]) == "VOID")
    )
    broken = wrong("max_steps") & ~no_steps
    for m in metrics:
        broken = broken | wrong(m)
    broken = broken | (wrong("step") & ~no_steps)
    step = F.coalesce(_number(s["step"]), F.lit(0.0))
    from_steps = F.when(no_steps, 0.0).otherwise(step / F.coalesce(_number(s["max_steps"]), F.lit(1.0)))
    told = F.when(has["fraction"], _number(s["fraction"])).otherwise(0.0)
    bad = F.coalesce(~F.col("_s_object") | F.when(counted, broken).otherwise(told.isNull()), F.lit(True))
    fraction = F.when(bad, 0.0).when(counted, from_steps).otherwise(told)
    detail = F.when(bad, "").when(counted, F.concat_ws("  ", *parts)).otherwise(_shown(s["detail"], ""))
    out = parsed.withColumn("_fraction", fraction).withColumn("_detail", detail)
    kept = [c for c in snapshots.columns if c not in ("fraction", "detail")]
    return out.select(*kept, F.col("_fraction").alias("fraction"), F.col("_detail").alias("detail"))


def latest_progress(rows: DataFrame, key: str = "run_id", order: Column | None = None) -> DataFrame:
    """Newest progress per run. Remote rows count only above zero, local rows always."""
    at = F.struct("ts", "event_id") if order is None else order
    kept = rows.filter(F.col("is_local") | (F.col("fraction") > 0))
    last = kept.groupBy(key).agg(F.max_by(F.struct("ts", "fraction", "detail"), at).alias("_p"))
    return last.select(key, "_p.ts", "_p.fraction", "_p.detail")


def denoise(lines: DataFrame, column: str = "line", noise: list[str] = C.LOG_NOISE) -> DataFrame:
    quiet = F.lit(True)
    for text in noise:
        quiet = quiet & ~F.contains(F.col(column), F.lit(text))
    return lines.filter(quiet)
