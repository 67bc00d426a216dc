"""Metric history, heartbeat and offer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import series
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query

DAY = 24 * 3600


@query("last_metric", O.sql(["history"], """
SELECT run_id, step, eval_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn
FROM history WHERE eval_loss IS NOT NULL) WHERE rn = 1"""))
def last_metric(spark, sf):
    return series.last_metric(V.eval_history(spark, sf))


@query("best_checkpoint", O.sql(["history"], """
SELECT run_id, step, eval_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eval_loss, step) AS rn
FROM history WHERE eval_loss IS NOT NULL) WHERE rn = 1"""))
def best_checkpoint(spark, sf):
    return series.best_checkpoint(V.eval_history(spark, sf))


@query("early_stop", O.sql(["history"], """
SELECT run_id, min(step) AS stop_step FROM (
  SELECT *, max(CASE WHEN low IS NULL OR eval_loss < low THEN n END) OVER (PARTITION BY run_id ORDER BY step) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n,
           min(eval_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
    FROM history WHERE eval_loss IS NOT NULL)) WHERE n - best >= 3 GROUP BY run_id"""))
def early_stop(spark, sf):
    return series.early_stop(V.eval_history(spark, sf))


@query("heartbeat_gaps", f"""
SELECT run_id, last_seen, next_seen, (epoch_us(next_seen) - epoch_us(last_seen))/1000000.0::DOUBLE AS gap_seconds FROM (
  SELECT user_id AS run_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_seen, ts AS next_seen FROM events)
WHERE epoch_us(next_seen) - epoch_us(last_seen) > {DAY * 1_000_000}""")
def heartbeat_gaps(spark, sf):
    beats = V.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts")
    return series.heartbeat_gaps(beats, DAY)


@query("cheapest_offer", """
SELECT brand, id, gpu_name, price FROM (
  SELECT p_brand AS brand, p_partkey AS id, p_name AS gpu_name, price,
         row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(price, 'infinity'::DOUBLE), p_partkey) AS rn
  FROM (SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price FROM part)) WHERE rn = 1""")
def cheapest_offer(spark, sf):
    offers = V.table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("gpu_name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price"),
    )
    return series.cheapest(offers, "brand", "price", "id")
