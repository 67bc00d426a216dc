"""Labelling, prompt and array queries over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions import scenes
from labelloom.operators import labelling, tokens
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query

LABEL = ["label.stat", "label.action", "label.target_object_id", "label.confidence"]


@query("dominant_stat", O.sql(["top"], "SELECT request_id, stat, value FROM top"))
def dominant_stat(spark, sf):
    top = labelling.with_dominant(V.requests(spark, sf))
    return top.select("request_id", "top.stat", "top.value")


@query("label_scenes", O.sql(["labels"], "SELECT request_id, stat, action, target_object_id, confidence FROM labels"))
def label_scenes(spark, sf):
    return V.labelled(spark, sf).select("request_id", *LABEL)


@query("label_flat_objects", O.sql(["flat_labels"], "SELECT request_id, stat, action, target_object_id, confidence FROM flat_labels"))
def label_flat_objects(spark, sf):
    near = labelling.nearest_by_stat(V.scene_objects(spark, sf), V.OBJECT_ORDER)
    return labelling.label_flat(V.requests(spark, sf), near)


@query("nearest_object", O.sql(["flat_objects"], """
SELECT request_id, type, count(*)::BIGINT AS objects, arg_min(id, (distance, pos)) AS nearest_id, min(distance) AS distance
FROM flat_objects GROUP BY request_id, type"""))
def nearest_object(spark, sf):
    near = labelling.nearest_by_type(V.scene_objects(spark, sf), V.OBJECT_ORDER)
    return near.select("request_id", "type", "objects", "nearest_id", "place.distance")


@query("available_actions", O.sql(["allowed"], """
SELECT request_id, string_agg(action, ',' ORDER BY ord) AS actions, count(*)::INT AS n FROM allowed GROUP BY request_id"""))
def available_actions(spark, sf):
    acts = V.scenes(spark, sf).select("request_id", F.expr(scenes.available_actions()).alias("a"))
    return acts.select("request_id", F.array_join("a", ",").alias("actions"), F.size("a").alias("n"))


@query("shuffle_actions", O.sql(["actions_text"], "SELECT request_id, actions_text AS actions FROM actions_text"))
def shuffle_actions(spark, sf):
    acts = F.expr(scenes.shuffled_actions("request_id"))
    return V.scenes(spark, sf).select("request_id", F.array_join(acts, ", ").alias("actions"))


@query("render_prompt", O.sql(["prompts"], "SELECT request_id, prompt FROM prompts"))
def render_prompt(spark, sf):
    return labelling.with_prompt(V.scenes(spark, sf)).select("request_id", "prompt")


@query("render_completion", O.sql(["examples"], "SELECT request_id, completion FROM examples"))
def render_completion(spark, sf):
    return V.examples(spark, sf).select("request_id", "completion")


@query("unpivot_stats", O.sql(["stats"], "SELECT request_id, stat, value FROM stats"))
def unpivot_stats(spark, sf):
    return labelling.unpivot_stats(V.requests(spark, sf))


@query("rule_lookup_join", O.sql(["flat_objects"], """
SELECT k.type, k.stat, k.actions, count(*)::BIGINT AS objects, min(distance) AS nearest
FROM flat_objects o JOIN kinds k ON k.type = o.type GROUP BY k.type, k.stat, k.actions""",
    kinds="""SELECT ['bowl','bed','toy','player','pet'][k+1] AS type, ['hunger','tiredness','boredom','social','social'][k+1] AS stat,
    ['EAT/DRINK','SLEEP','PLAY/FETCH','SOCIAL/FOLLOW','SOCIAL/FOLLOW'][k+1] AS actions FROM (SELECT DISTINCT p_partkey % 5 AS k FROM part)"""))
def rule_lookup_join(spark, sf):
    """Rules as a table: each object type with the stat and actions that it serves."""
    number = F.pmod(F.col("p_partkey"), F.lit(5))
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") + 1).cast("int"))
    serves = {t: s for s, types in C.STAT_TYPES.items() for t in types}
    rules = (
        V.table(spark, sf, "part").select(number.alias("k")).distinct().select(
            at(C.OBJECT_TYPES).alias("type"),
            at([serves[t] for t in C.OBJECT_TYPES]).alias("stat"),
            at(["/".join(C.STAT_ACTIONS[serves[t]]) for t in C.OBJECT_TYPES]).alias("actions"),
        )
    )
    joined = labelling.rule_lookup(V.scene_objects(spark, sf), rules, on="type")
    return joined.groupBy("type", "stat", "actions").agg(
        F.count("*").alias("objects"), F.min("distance").alias("nearest")
    )


@query("validate_rows", O.sql(["requests", "objects"], """
SELECT request_id, concat_ws(';',
  CASE WHEN hunger*1.1 > 1 THEN 'range:hunger' END, CASE WHEN boredom*1.1 > 1 THEN 'range:boredom' END,
  CASE WHEN social*1.1 > 1 THEN 'range:social' END, CASE WHEN toilet*1.1 > 1 THEN 'range:toilet' END,
  CASE WHEN tiredness*1.1 > 1 THEN 'range:tiredness' END,
  CASE WHEN tick % 7 = 0 THEN 'required:tick' END,
  CASE WHEN EXISTS (SELECT 1 FROM objects o WHERE o.request_id = r.request_id AND o.type = 'toy' AND o.distance > 20) THEN 'enum:object' END) AS violations
FROM requests r"""))
def validate_rows(spark, sf):
    """Requests made partly illegal: scaled stats, lost ticks, an unknown object type."""
    odd = F.transform(
        "objects",
        lambda o: F.struct(
            o["id"].alias("id"),
            F.when((o["type"] == "toy") & (o["distance"] > 20), "ball").otherwise(o["type"]).alias("type"),
            o["distance"].alias("distance"),
        ),
    )
    scaled = F.struct(*[(F.col(f"stats.{s}") * 1.1).alias(s) for s in C.PROMPT_STATS])
    rows = V.scenes(spark, sf).select(
        "request_id", scaled.alias("stats"), odd.alias("objects"),
        F.when(F.col("tick") % 7 != 0, F.col("tick")).alias("tick"),
    )
    return rows.select("request_id", F.array_join(F.expr(labelling.request_violations()), ";").alias("violations"))


_WORD_IDS = "list_transform(regexp_extract_all({0}, '\\S+'), lambda w: (('0x'||substr(md5(w),1,6))::UBIGINT % 32000)::INT)"
_MASKED = f"""SELECT conv_id, turn,
    list_concat([1], {_WORD_IDS.format("prompt||completion")})[1:512] AS input_ids,
    least(len({_WORD_IDS.format("prompt")}), 512) + 1 AS masked FROM chat_pairs"""


@query("mask_labels", O.sql(["chat_pairs"], """
SELECT conv_id, turn, len(input_ids)::INT AS tokens, masked::INT AS masked,
       md5(array_to_string(list_concat(list_transform(range(masked), lambda i: -100), input_ids[masked+1:]), ',')) AS labels_md5
FROM ids WHERE len(input_ids) > masked""", ids=_MASKED))
def mask_labels(spark, sf):
    rows = tokens.mask_labels(tokens.tokenise_words(V.chat_pairs(spark, sf)))
    hidden = F.size(F.filter("labels", lambda x: x == C.IGNORE_INDEX))
    return rows.select(
        "conv_id", "turn", F.size("input_ids").alias("tokens"), hidden.alias("masked"),
        F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")).alias("labels_md5"),
    )


def make_word_tokenizer():
    """Tokenizer of the same words and ids as the column version."""
    import hashlib
    import re

    def encode(texts, special):
        first = [tokens.BOS_ID] if special else []
        word = re.compile(r"[^ \t\n\x0b\f\r]+")
        return [
            first + [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % tokens.VOCABULARY for w in word.findall(t)]
            for t in texts
        ]

    return encode


@query("tokenise_pairs", O.sql(["chat_pairs"], """
SELECT conv_id, turn, len(input_ids)::INT AS tokens, md5(array_to_string(input_ids, ',')) AS ids_md5, masked::INT AS masked FROM ids""", ids=_MASKED))
def tokenise_pairs(spark, sf):
    """Token ids from a user tokenizer that runs in Arrow batches."""
    rows = tokens.tokenise(V.chat_pairs(spark, sf), make_word_tokenizer)
    return rows.select(
        "conv_id", "turn", F.size("input_ids").alias("tokens"),
        F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"),
        (F.size("prompt_ids") + 1).alias("masked"),
    )
