"""Synthetic data queries: one generated row per order id."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.text import fixed
from labelloom.operators import generate, numbering
from labelloom.plans import oracle as O
from labelloom.plans import oracle_made  # noqa: F401
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources.session import work_path

STATS = [f"stats.{s}" for s in C.LABEL_STATS]
_STATS = ", ".join(C.LABEL_STATS)


def _ids(spark, sf):
    return V.order_ids(spark, sf)


def _objects_text():
    parts = F.transform("objects", lambda o: F.concat_ws("|", o["id"], o["type"], fixed(o["distance"], 1)))
    return F.array_join(parts, ";").alias("objects")


_TEXT = """SELECT request_id, string_agg(id||'|'||type||'|'||printf('%.1f', distance), ';' ORDER BY pos) AS objects FROM {0}objects GROUP BY 1"""


@query("stratify", f"SELECT o_orderkey AS request_id, {oracle_made.STATS}[(o_orderkey % 5)+1] AS dominant FROM orders")
def stratify(spark, sf):
    return generate.stratify(_ids(spark, sf))


@query("stratify_exactly", f"""
SELECT id AS request_id, {oracle_made.STATS}[((row_number() OVER (ORDER BY id) - 1) % 5)+1] AS dominant
FROM (SELECT o_orderkey * 5 + 2 AS id FROM orders)""")
def stratify_exactly(spark, sf):
    """Ids with holes, all alike modulo the number of stats."""
    return generate.stratify_exactly(_ids(spark, sf).select((F.col("request_id") * 5 + 2).alias("request_id")))


@query("zip_rows", """
SELECT a.place, prompt, completion FROM
  (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, text AS prompt FROM conversations WHERE role = 'user') a
  JOIN (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, text AS completion FROM conversations WHERE role = 'assistant') b
  USING (place)""")
def zip_rows(spark, sf):
    """All user texts beside all assistant texts, by position."""
    turns = V.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    sides = [turns.filter(F.col("role") == r) for r in ("user", "assistant")]
    pairs = numbering.zip_rows(sides[0], ["conv_id", "turn"], sides[1], ["conv_id", "turn"])
    return pairs.select("place", F.col("left.text").alias("prompt"), F.col("right.text").alias("completion"))


@query("gen_stats", O.sql(["gen_requests"], f"SELECT request_id, dominant, second, {_STATS} FROM gen_requests"))
def gen_stats(spark, sf):
    rows = generate.add_stats(generate.stratify(_ids(spark, sf)))
    return rows.select("request_id", "dominant", "second", *STATS)


@query("gen_scenes", O.sql(["gen_requests", "gen_objects"], """
SELECT r.request_id, r.dominant, r.tick, coalesce(t.objects, '') AS objects FROM gen_requests r LEFT JOIN t USING (request_id)""",
    t=_TEXT.format("gen_")))
def gen_scenes(spark, sf):
    rows = generate.make_requests(_ids(spark, sf))
    return rows.select("request_id", "dominant", "tick", _objects_text())


@query("gen_examples", O.sql(["gen_examples"], "SELECT request_id, prompt, completion FROM gen_examples"))
def gen_examples(spark, sf):
    return generate.make_examples(_ids(spark, sf)).select("request_id", "prompt", "completion")


@query("gen_probes", O.sql(["probe_requests", "probe_objects"], f"""
SELECT r.request_id, r.kind, r.stat, r.second, r.tick, {_STATS}, coalesce(t.objects, '') AS objects,
       CASE WHEN r.kind = 'stat' AND r.stat <> 'toilet' THEN 'target_0' END AS expected_target
FROM probe_requests r LEFT JOIN t USING (request_id)""", t=_TEXT.format("probe_")))
def gen_probes(spark, sf):
    rows = generate.make_probes(_ids(spark, sf))
    return rows.select("request_id", "kind", "stat", "second", "tick", *STATS, _objects_text(), "expected_target")


def _verdict(name):
    return f"""SELECT '{name}' AS split, sum(n)::BIGINT AS total, sum(n)::BIGINT AS valid, 0::BIGINT AS invalid, count(*)::BIGINT AS classes,
  count_if(share < 0.05 AND total >= 50)::BIGINT AS under, count_if(share > 0.25 AND total >= 50)::BIGINT AS over,
  count_if((share < 0.05 OR share > 0.25) AND total >= 50) = 0 AS passed
FROM (SELECT action, count(*) AS n, count(*)/sum(count(*)) OVER () AS share, sum(count(*)) OVER () AS total FROM {name}_labels GROUP BY 1)"""


@query("generate_dataset", O.sql(["train_labels", "eval_labels"], _verdict("train") + " UNION ALL " + _verdict("eval")))
def generate_dataset(spark, sf):
    """Whole job: ten parts train, one part eval, written, read back and judged."""
    ids = _ids(spark, sf)
    is_eval = F.col("request_id") % 11 == 10
    splits = {"train": ids.filter(~is_eval), "eval": ids.filter(is_eval)}
    return generate.generate_dataset(splits, work_path(spark, "dataset"))
