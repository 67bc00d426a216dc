"""Workload tables, derived row by row from the given tables.

They give every operator its input: requests with nested scenes (orders), flat scene
objects (lineitem), raw model answers, run changes and progress (events), models
(supplier) and chat pairs (conversations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.operators.labelling import label_requests, render_examples
from labelloom.sources.jsonl import json_line
from labelloom.sources.session import work_path

MAX_OBJECTS = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _object_type(number: Column) -> Column:
    types = F.array(*[F.lit(t) for t in C.OBJECT_TYPES])
    return F.element_at(types, (F.pmod(number, F.lit(5)) + 1).cast("int"))


def _share(key: Column, factor: int, shift: int) -> Column:
    return ((key * factor + shift) % 101).cast("double") / F.lit(100.0)


def stats_of(key: Column) -> Column:
    return F.struct(
        _share(key, 37, 11).alias("hunger"),
        _share(key, 53, 29).alias("boredom"),
        _share(key, 71, 43).alias("social"),
        _share(key, 89, 61).alias("toilet"),
        _share(key, 97, 7).alias("tiredness"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """request_id, tick and stats only."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(key.alias("request_id"), (key % 10001).alias("tick"), stats_of(key).alias("stats"))


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with 0 to 5 nested objects; equal distances occur."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    places = F.array(*[F.lit(i).cast("bigint") for i in range(MAX_OBJECTS)])
    objects = F.transform(
        F.slice(places, 1, (cust % MAX_OBJECTS).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("obj_"), i.cast("string")).alias("id"),
            _object_type(key * (i + 3) + cust * (i * 2 + 1)).alias("type"),
            ((((key * 13 + i * i * 29 + cust * i * 7) % 50) + 2).cast("double") / 2.0).alias("distance"),
        ),
    )
    return o.select(
        key.alias("request_id"),
        (key % 10001).alias("tick"),
        stats_of(key).alias("stats"),
        objects.alias("objects"),
    )


OBJECT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def scene_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects as their own table; ``OBJECT_ORDER`` is their order in the scene."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", *OBJECT_ORDER, "l_quantity")
    return lines.select(
        F.col("l_orderkey").alias("request_id"),
        F.concat_ws("_", F.lit("obj"), *[F.col(c).cast("string") for c in OBJECT_ORDER[:3]]).alias("id"),
        _object_type(F.col("l_partkey")).alias("type"),
        F.col("l_quantity").alias("distance"),
        *OBJECT_ORDER,
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return label_requests(scenes(spark, sf))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return render_examples(labelled(spark, sf))


def example_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Examples as JSONL text with broken, blank and odd lines among them."""
    kind = F.col("request_id") % 50
    good = json_line(F.col("prompt"), F.col("completion"))
    value = (
        F.when(kind == 0, "{bad")
        .when(kind == 1, "")
        .when(kind == 2, " \t ")
        .when(kind == 3, "[1]")
        .when(kind == 4, '"text"')
        .when(kind == 5, F.concat(good, F.lit(" tail")))
        .when(kind == 6, F.concat(F.lit('{"prompt":"Stats","completion":'), F.col("completion"), F.lit("}")))
        .when(kind == 7, json_line(F.lit("no marker").alias("prompt"), F.col("completion")))
        .when(kind == 8, json_line(F.col("prompt"), F.lit('{"action":"FLY"}').alias("completion")))
        .when(kind == 9, F.concat(F.lit("\t"), good, F.lit("  ")))
        .otherwise(good)
    )
    return examples(spark, sf).select("request_id", value.alias("value"))


# Folder of the stored lines, per application and input.
_lines: dict[tuple[str, str], str] = {}


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Example lines, written in the shared folder once per application and read from there."""
    made = (spark.sparkContext.applicationId, sf)
    if made not in _lines:
        path = work_path(spark, "lines")
        example_lines(spark, sf).write.parquet(path)
        _lines[made] = path
    return spark.read.schema("request_id bigint, value string").parquet(_lines[made])


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Raw model texts with every parser outcome, each keyed to a request."""
    e = F.col("event_id")
    kind = e % 12
    raw = (
        F.when(kind == 0, '{"action": "IDLE"}')
        .when(
            kind == 1,
            F.concat(
                F.lit('Here you go: {"action": "EAT", "target_object_id": "obj_'),
                (e % 7).cast("string"),
                F.lit('", "confidence": 0.75} - done'),
            ),
        )
        .when(kind == 2, "{action: IDLE}")
        .when(kind == 3, '{"target_object_id": "obj_1"}')
        .when(kind == 4, F.concat(F.lit("no idea what to do about "), F.col("props")))
        .when(kind == 5, '{"action": "FLY"}')
        .when(kind == 6, '{"action":"FETCH","target_object_id":"obj_2","confidence":0.8,"confidence":0.8,"conf')
        .when(kind == 7, '{"target_object_id":"obj_3","confidence":0.8,"confid')
        .when(kind == 8, '{"meta":{"v":1},"action":"EAT"}')
        .when(kind == 9, '{"action":"SLEEP","target_object_id":5}')
        .when(kind == 10, '{"stat":"social","action":"SOCIAL","target_object_id":null,"confidence":1}')
        .otherwise('{"stat":"toilet","action":"TOILET","confidence":0.5}')
    )
    events = table(spark, sf, "events").select("event_id", "props")
    return events.select(e.alias("event_id"), e.alias("request_id"), raw.alias("raw"))


def _on_first_day(key: str) -> Column:
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {key} % 86400)")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run registry snapshot, one row per run."""
    c = F.col("c_custkey")
    created = _on_first_day("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("id"),
        F.col("c_nationkey").cast("bigint").alias("model_id"),
        F.concat(F.lit("training-"), c.cast("string")).alias("workflow_id"),
        F.element_at(F.array(*[F.lit(s) for s in C.RUN_STATUSES]), (c % 8 + 1).cast("int")).alias("status"),
        F.when(c % 8 > 5, F.col("c_acctbal") / 10000).alias("eval_valid_pct"),
        F.lit(None).cast("double").alias("progress"),
        F.lit(None).cast("string").alias("progress_detail"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def run_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only status log of runs; seq is unique."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending")
        .when(kind == "view", "training")
        .when(kind == "click", "evaluating")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        (F.col("user_id") % 10).alias("model_id"),
        F.col("event_id").alias("seq"),
        "ts",
        status.alias("status"),
        F.when(kind == "view", F.col("value")).alias("progress"),
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    names = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("description"))
    created = _on_first_day("s_suppkey")
    return (
        table(spark, sf, "supplier")
        .join(names, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            s.alias("id"),
            F.col("s_name").alias("name"),
            "description",
            F.concat(F.lit("base-"), (F.col("s_nationkey") % 4).cast("string")).alias("base_model"),
            (s % 5 + 1).cast("int").alias("epochs"),
            F.when(s % 3 == 0, "").when(s % 3 == 1, "local").otherwise("cluster").alias("backend"),
            F.when(s % 4 == 0, "").otherwise(F.concat(F.lit("gguf/"), F.col("s_name"))).alias("artifact"),
            (s == 3).alias("is_active"),
            created.alias("created_at"),
            created.alias("updated_at"),
        )
    )


def progress_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_rows(table(spark, sf, "events").select("event_id", "user_id", "ts"))


def snapshot_rows(events: DataFrame) -> DataFrame:
    """Progress bodies in both shapes, with zero or missing counts, null metrics and broken text among them."""
    e = F.col("event_id")
    num = lambda n: (e % n).cast("string")
    body = (
        F.when(
            e % 4 == 0,
            F.concat(F.lit('{"fraction": 0.'), num(5), F.lit(', "detail": "stage '), num(3), F.lit('"}')),
        )
        .when(
            e % 4 == 1,
            F.concat(F.lit('{"step": '), num(50), F.lit(', "max_steps": 50, "epoch": 1.5, "elapsed_s": '),
                     num(900), F.lit(', "loss": 0.'), num(97), F.lit("}")),
        )
        .when(e % 4 == 2, F.concat(F.lit('{"step": '), num(50), F.lit(', "max_steps": 0, "eval_loss": 0.25}')))
        .when(e % 24 == 3, "{}")
        .when(e % 24 == 7, '{"loss": 0.5}')
        .when(e % 24 == 11, '{"step": 10.0, "max_steps": 20}')
        .when(e % 24 == 15, '{"step": 5, "max_steps": 10, "loss": null}')
        .otherwise("{broken")
    )
    return events.select(F.col("user_id").alias("run_id"), "ts", "event_id", body.alias("body"))


def eval_history(spark: SparkSession, sf: str) -> DataFrame:
    """Metric log per run; step grows, some entries carry no loss."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("eval_loss"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))


def role_holders(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(F.col("o_custkey").alias("user_id")).distinct()


def chat_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows; no window over a conversation."""
    c = table(spark, sf, "conversations")
    asked = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(said, ["conv_id", "turn"])


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document text as run logs, one row per line, with a summary line at the end."""
    return split_logs(table(spark, sf, "documents"))


def split_logs(d: DataFrame) -> DataFrame:
    summary = F.concat(
        F.lit("\nWarning: Permanently added host"),
        F.lit("\nValid: "), (F.col("doc_id") % 41).cast("string"),
        F.lit("/40 ("), (F.col("doc_id") % 41).cast("string"), F.lit(".5%)  [DONE]"),
    )
    return d.select(
        F.col("doc_id").alias("run_id"),
        F.posexplode(F.split(F.concat(F.col("text"), summary), "\n")).alias("pos", "line"),
    )


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    """One row id per order, the input of the generators."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
