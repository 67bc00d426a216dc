"""Ordered per-run operators that stay correct and spread out when one run is huge.

A window over a whole run would gather it in one task. Here rows are reduced to one
summary per (run, block) first; only summaries are windowed per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom.functions import constants as C

BLOCK_STEPS = 1_000_000


def in_utc(clock: Column) -> Column:
    """The moment at which a UTC clock shows a time without zone, whatever the session's zone is."""
    return F.concat(clock.cast("string"), F.lit("Z")).cast("timestamp")


def utc_clock(moment: Column) -> Column:
    """What a UTC clock shows at a moment, as a time without zone."""
    seconds = (F.unix_micros(moment) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def current_rows(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Last change row per key, as a map-side reduced aggregate."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def last_metric(history: DataFrame, key: str = "run_id", step: str = "step", metric: str = "eval_loss") -> DataFrame:
    known = history.filter(F.col(metric).isNotNull())
    return known.groupBy(key).agg(F.max(step).alias(step), F.max_by(metric, step).alias(metric))


def best_checkpoint(history: DataFrame, key: str = "run_id", step: str = "step", metric: str = "eval_loss") -> DataFrame:
    """Step with the lowest metric; the earliest one wins a tie."""
    known = history.filter(F.col(metric).isNotNull())
    best = known.groupBy(key).agg(F.min(F.struct(metric, step)).alias("_b"))
    return best.select(key, F.col(f"_b.{step}").alias(step), F.col(f"_b.{metric}").alias(metric))


def tail(lines: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Last n lines per key; each task keeps at most n rows per key before the shuffle."""
    latest = W.partitionBy(key).orderBy(F.desc(order))
    return lines.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n).drop("_rank")


def heartbeat_gaps(beats: DataFrame, timeout_seconds: int, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Silences longer than the timeout: key, last_seen, next_seen, gap_seconds.

    Blocks are as long as the timeout, so a too long gap always spans two blocks:
    the first and last beat per block are enough and no row-level window is needed.
    """
    zoneless = beats.schema[ts].dataType.typeName() == "timestamp_ntz"

    def micros(column: str) -> Column:
        return F.unix_micros(in_utc(F.col(column)) if zoneless else F.col(column).cast("timestamp"))

    limit = timeout_seconds * 1_000_000
    start = micros(ts) - F.pmod(micros(ts), F.lit(limit))
    blocks = beats.groupBy(key, start.alias("_block")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    before = F.lag("_last").over(W.partitionBy(key).orderBy("_block"))
    gap = micros("next_seen") - micros("last_seen")
    return (
        blocks.select(key, before.alias("last_seen"), F.col("_first").alias("next_seen"))
        .filter(gap > limit)
        .withColumn("gap_seconds", gap / F.lit(1_000_000.0))
    )


def early_stop(
    history: DataFrame,
    patience: int = C.PATIENCE,
    key: str = "run_id",
    step: str = "step",
    metric: str = "eval_loss",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """First step per run at which ``patience`` evals in a row brought no new best.

    Entries without a metric are not evals. Rows meet once, per (run, block), where the
    lowest metric of earlier blocks is known; there a block becomes a small summary: its
    first stop behind a new best of its own, the place of its last new best, and its first
    evals before any, of which earlier blocks decide whether they are a stop. Only
    summaries are folded per run.
    """
    evals = history.filter(F.col(metric).isNotNull()).select(
        key, F.floor(F.col(step) / block_steps).alias("_block"), step, metric
    )
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    lows = evals.groupBy(key, "_block").agg(F.min(metric).alias("_low"))
    lows = lows.select(key, "_block", F.min("_low").over(earlier).alias("_low_before"))
    in_block = W.partitionBy(key, "_block").orderBy(step)
    past = in_block.rowsBetween(W.unboundedPreceding, -1)
    so_far = in_block.rowsBetween(W.unboundedPreceding, 0)
    marked = (
        evals.join(lows, [key, "_block"])
        .withColumn("_best_before", F.least(F.min(metric).over(past), F.col("_low_before")))
        .withColumn("_no", F.row_number().over(in_block))
        .withColumn("_new", F.col("_best_before").isNull() | (F.col(metric) < F.col("_best_before")))
        .withColumn("_best_no", F.max(F.when(F.col("_new"), F.col("_no"))).over(so_far))
    )
    leading = F.col("_best_no").isNull() & (F.col("_no") <= patience)
    blocks = marked.groupBy(key, "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_best_no").alias("_best_no"),
        F.min(F.when(F.col("_no") - F.col("_best_no") >= patience, F.col(step))).alias("_own_stop"),
        F.map_from_entries(F.collect_list(F.when(leading, F.struct("_no", step)))).alias("_first_steps"),
    )
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    placed = blocks.withColumn("_n_before", before).withColumn(
        "_carried", F.max(F.col("_n_before") + F.col("_best_no")).over(earlier)
    )
    # evals that earlier blocks have waited already
    due = (patience - (F.col("_n_before") - F.col("_carried"))).cast("int")
    stop = F.least("_own_stop", F.try_element_at("_first_steps", due))
    return placed.groupBy(key).agg(F.min(stop).alias("stop_step")).filter(F.col("stop_step").isNotNull())


def cheapest(offers: DataFrame, group: str, price: str, order: str) -> DataFrame:
    """Row with the lowest price per group; no price counts as infinity, first wins ties."""
    rank = F.struct(F.coalesce(F.col(price), F.lit(float("inf"))).alias("p"), F.col(order).alias("o"))
    rest = [c for c in offers.columns if c != group]
    best = offers.groupBy(group).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(group, *[F.col(f"_best.{c}").alias(c) for c in rest])


def newest_first(rows: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(created), key)


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """First n rows by an order column; each task keeps only n rows."""
    return rows.orderBy(order).limit(n)
