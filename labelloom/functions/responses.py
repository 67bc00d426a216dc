"""Model answers: find the JSON, check it, recover cut-off text, repair targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.scenes import lookup, nearest

STATUSES = ["ok", "ok_truncated", "bad_json", "bad_schema", "bad_partial", "no_json"]

_ANSWER_SCHEMA = (
    "stat variant, action variant, target_object_id variant, confidence variant, _bad string"
)
_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_bad",
    "allowSingleQuotes": "false",
}
_NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)\s*$"


ANSWER_FIELDS = ("stat", "action", "target_object_id", "confidence")


def check_answers(df: DataFrame, json_text: Column, prefix: str = "_a") -> DataFrame:
    """Add the checked fields of a JSON object as flat columns.

    Columns: <prefix>_ok (the text parses), <prefix>_valid and one per answer field,
    null unless valid. Types are checked on the parsed variant, since a plain cast
    would turn a number into a string. Numbers in text and booleans are accepted as
    confidence. The steps are separate projections, so each is computed once.
    """
    p = prefix
    staged = df.withColumn(f"{p}_j", F.from_json(json_text, _ANSWER_SCHEMA, _JSON_OPTIONS))
    parts: dict[str, Column] = {f"{p}_ok": F.col(f"{p}_j").isNotNull() & F.col(f"{p}_j._bad").isNull()}
    for name in ANSWER_FIELDS:
        field = F.col(f"{p}_j.{name}")
        parts[f"{p}_{name}_kind"] = F.coalesce(F.schema_of_variant(field), F.lit("VOID"))
        parts[f"{p}_{name}_text"] = F.try_variant_get(field, "$", "string")
    staged = staged.withColumns(parts).drop(f"{p}_j")
    kind, text = F.col(f"{p}_confidence_kind"), F.col(f"{p}_confidence_text")
    number = (
        F.when(kind == "VOID", F.lit(None).cast("double"))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when((kind == "STRING") & ~text.rlike(_NUMBER_TEXT), F.lit(None).cast("double"))
        .otherwise(text.try_cast("double"))
    )
    staged = staged.withColumn(f"{p}_number", number)
    valid = (
        F.col(f"{p}_ok")
        & (F.col(f"{p}_action_kind") == "STRING")
        & F.coalesce(F.col(f"{p}_action_text").isin(C.ACTIONS), F.lit(False))
        & F.col(f"{p}_stat_kind").isin("VOID", "STRING")
        & F.col(f"{p}_target_object_id_kind").isin("VOID", "STRING")
        & ((kind == "VOID") | F.col(f"{p}_number").isNotNull())
    )
    staged = staged.withColumn(f"{p}_valid", F.coalesce(valid, F.lit(False)))
    ok = F.col(f"{p}_valid")
    fields = {f"{p}_{n}": F.when(ok, F.col(f"{p}_{n}_text")) for n in ("stat", "action", "target_object_id")}
    fields[f"{p}_confidence"] = F.when(ok, F.col(f"{p}_number"))
    temporary = [f"{p}_{n}_{t}" for n in ANSWER_FIELDS for t in ("kind", "text")] + [f"{p}_number"]
    return staged.withColumns(fields).drop(*temporary)


def parse_responses(df: DataFrame, raw: str = "raw", into: str = "answer") -> DataFrame:
    """Add a struct (status, stat, action, target_object_id, confidence).

    The first flat ``{...}`` decides. Only when there is none is the action taken
    from cut-off text; a found but invalid object is never retried.
    """
    text = F.col(raw)
    part_action = F.nullif(F.regexp_extract(text, r'(?U)"action"\s*:\s*"([A-Z]+)"', 1), F.lit(""))
    part_target = F.nullif(
        F.regexp_extract(text, r'(?U)"target_object_id"\s*:\s*"([^"]+)"', 1), F.lit("")
    )
    found = df.withColumn("_json", F.nullif(F.regexp_extract(text, r"\{[^{}]*\}", 0), F.lit("")))
    read = check_answers(found, F.col("_json")).withColumn(
        "_part", F.when(F.col("_json").isNull(), part_action)
    )
    status = (
        F.when(F.col("_a_valid"), "ok")
        .when(F.col("_json").isNotNull() & ~F.col("_a_ok"), "bad_json")
        .when(F.col("_json").isNotNull(), "bad_schema")
        .when(F.col("_part").isNull(), "no_json")
        .when(F.col("_part").isin(C.ACTIONS), "ok_truncated")
        .otherwise("bad_partial")
    )
    rated = read.withColumn("_status", status)
    cut = F.col("_status") == "ok_truncated"
    answer = F.struct(
        F.col("_status").alias("status"),
        F.col("_a_stat").alias("stat"),
        F.when(cut, F.col("_part")).otherwise(F.col("_a_action")).alias("action"),
        F.when(cut, part_target).otherwise(F.col("_a_target_object_id")).alias("target_object_id"),
        F.col("_a_confidence").alias("confidence"),
    )
    return rated.withColumn(into, answer).select(*df.columns, into)


def is_ok(status: Column) -> Column:
    return status.isin("ok", "ok_truncated")


def repair_targets(df: DataFrame, answer: str = "answer", objects: str = "objects") -> DataFrame:
    """Give actions that need an object a legal target.

    A missing, unknown or wrong-type target becomes the nearest legal object; the
    repaired answer loses its stat. With no legal object the answer stays as it is.
    """
    fits = f"exists({objects}, o -> array_contains(_types, o.type) and o.id = {answer}.target_object_id)"
    best = f"if(_types is null or coalesce({fits}, false), null, {nearest(objects, '_types')})"
    staged = df.withColumn("_types", F.expr(lookup(C.ACTION_TYPES, f"{answer}.action"))).withColumn(
        "_best", F.expr(best)
    )
    repaired = (
        f"struct({answer}.status as status, if(_best is null, {answer}.stat, null) as stat, "
        f"{answer}.action as action, coalesce(_best, {answer}.target_object_id) as target_object_id, "
        f"{answer}.confidence as confidence, _best is not null as repaired)"
    )
    return staged.withColumn(answer, F.expr(repaired)).drop("_types", "_best")


def safe_answers(df: DataFrame, answer: str = "answer", objects: str = "objects") -> DataFrame:
    """Parsed answers with targets repaired; every failure becomes the idle answer."""
    ok = f"{answer}.status in ('ok', 'ok_truncated')"
    kept = ", ".join(f"if({ok}, {answer}.{n}, null) as {n}" for n in ("target_object_id", "confidence"))
    safe = (
        f"struct({answer}.status as status, if({ok}, {answer}.stat, null) as stat, "
        f"if({ok}, {answer}.action, '{C.DEFAULT_ACTION}') as action, {kept}, "
        f"({ok}) and {answer}.repaired as repaired)"
    )
    return repair_targets(df, answer, objects).withColumn(answer, F.expr(safe))
