"""Weighted sampling with replacement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions import rand
from labelloom.operators.numbering import MARK, PART, carried, in_written_order, with_starts

# A 32-bit draw at rate one never reaches more copies than this.
MAX_COPIES = 13
CHUNK = 1024


def _copies(rate: str, u: str) -> str:
    """Poisson count for a rate of at most one, by inverting its distribution."""
    hits = []
    for k in range(MAX_COPIES):
        terms = " + ".join(f"pow({rate}, {j}) / {math.factorial(j)}.0D" for j in range(k + 1))
        hits.append(f"if({u} >= exp(-{rate}) * ({terms}), 1, 0)")
    return " + ".join(hits)


def _cut(ranges: DataFrame, size: int) -> DataFrame:
    """Ranges (_from, _to] cut into parts of ``size``."""
    parts = ranges.withColumn("_i", F.explode(F.expr(f"sequence(0L, (_to - _from - 1) div {size}L)")))
    start = F.col("_from") + F.col("_i") * size
    return parts.withColumn("_to", F.least(F.col("_to"), start + size)).withColumn("_from", start).drop("_i")


def weighted_resample(
    df: DataFrame, seed: int | str, key: str, weight: str = "weight", spread: bool = True
) -> DataFrame:
    """Each row repeated a Poisson(weight) number of times; n rows in expectation.

    A weight is cut into rates of at most one, drawn apart, so no weight is capped.
    A weight beyond ``CHUNK`` is cut into ranges that go to different tasks, again and
    again until a range has ``CHUNK`` pieces at most, so a row never makes more than that
    many at once. The greatest weight, looked up first, says how many rounds that takes.
    ``spread`` moves all rows once even if their weights are small, so that the copies of
    a rare class, whose rows may sit together, are made by many tasks.
    """
    greatest = df.agg(F.max(F.ceil(F.col(weight)).cast("bigint")).alias("m")).first()["m"] or 1
    rounds = 1 if spread else 0
    while CHUNK ** (rounds + 1) < greatest:
        rounds += 1
    count = F.greatest(F.ceil(F.col(weight)).cast("bigint"), F.lit(1))
    ranges = df.withColumn("_from", F.lit(0).cast("bigint")).withColumn("_to", count)
    # with a number, adaptive execution leaves these small rows in as many tasks
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(rounds, 0, -1):
        ranges = _cut(ranges, CHUNK**level).repartition(tasks, F.col(key), F.col("_from"))
    ranges = _cut(ranges, 1)
    pieces = ranges.withColumnRenamed("_to", "_piece").drop("_from")
    rate = F.least(F.lit(1.0), F.col(weight) - (F.col("_piece") - 1))
    u = F.expr(rand.unit(seed, key, "concat('copies-', _piece)"))
    drawn = (
        pieces.withColumn("_rate", rate).withColumn("_u", u).withColumn("_copies", F.expr(_copies("_rate", "_u")))
    )
    numbers = ", ".join(str(n) for n in range(1, MAX_COPIES + 1))
    copied = drawn.withColumn("copy", F.explode(F.expr(f"slice(array({numbers}), 1, _copies)")))
    return copied.drop("_piece", "_copies", "_rate", "_u")


# Weights become whole units, so that sums don't depend on the order of the rows.
UNIT_DIGITS = 12
TOTAL_DIGITS = 18
# Parts of the unit interval that a draw can name: 12 digits of an MD5 digest.
DRAW_DIGITS = 12


def _units(rows: DataFrame, weight: str) -> DataFrame:
    """Rows with a weight, and it as ``_units``: a whole number of 10^-12, or coarser if the total is large."""
    usable = F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")) & (F.col(weight) > 0)
    kept = rows.filter(usable)
    total = kept.agg(F.sum(F.col(weight).cast("double")).alias("t")).first()["t"] or 1.0
    if math.isinf(total):
        raise ValueError("weights must be finite")
    digits = min(UNIT_DIGITS, TOTAL_DIGITS - max(0, math.ceil(math.log10(total))))
    units = F.floor(F.col(weight).cast("double") * 10.0**digits + 0.5).cast("bigint")
    return kept.withColumn("_units", units).filter("_units > 0")


def resample_exactly(
    df: DataFrame, seed: int | str, key: str, weight: str = "weight", n: int | None = None
) -> DataFrame:
    """Exactly n rows drawn with replacement, in proportion to their weights; n defaults to the number of rows.

    Rows lie one behind the other on a line, each as long as its weight, and each draw is a
    point on it. Rows and points are put in order together by one range shuffle, which spreads
    a heavy row's points over many tasks; a point belongs to the last row before it. Points are
    counted per row and part before they become copies again. Rows are ordered by the digest of
    their key, so draws depend on seed, keys and weights only, and spread ``CHUNK`` copies at a time. ``copy`` counts a row's copies
    from 1. Rows with no weight, a null one, or one that is no number are never drawn; a draw
    from no weight at all stops the job.
    """
    spark = df.sparkSession
    if n is None:
        n = df.count()
    digest = F.md5(F.col(key).cast("string"))
    rows = _units(df, weight)
    placed = in_written_order(rows, F.coalesce(digest, F.lit("")), F.xxhash64(*df.columns), many_ties=True)
    total = int(placed.agg(F.sum("_units").alias("t")).first()["t"] or 0)
    if n and not total:
        raise ValueError("no row has a weight")
    line = with_starts(placed, "_units", "_at")
    word = F.conv(F.substring(F.md5(F.expr(rand.key_text(seed, "id", "'draw'"))), 1, DRAW_DIGITS), 16, 10)
    spot = F.expr(f"cast(_word as decimal(15,0)) * cast({total} as decimal(19,0)) div {16**DRAW_DIGITS}")
    points = spark.range(n).withColumn("_word", word).select(spot.alias("_at"), F.lit(None).cast("bigint").alias("_owner"), "id")
    starts = line.select("_at", F.col(MARK).alias("_owner"), F.lit(-1).cast("bigint").alias("id"))
    # a row stands before the points at its start
    owned = carried(in_written_order(starts.unionByName(points), "_at", "id"), "_owner").filter("id >= 0")
    pieces = owned.groupBy("_owner", PART).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_owner").orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first")
    ranges = pieces.select("_owner", first, "_n").withColumn("_from", F.col("_first")).withColumn("_to", F.col("_first") + F.col("_n"))
    drawn = _cut(ranges.drop("_first", "_n"), CHUNK).join(placed.withColumnRenamed(MARK, "_owner"), "_owner")
    # with a number, adaptive execution leaves these small rows in as many tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = F.explode(F.expr("sequence(_from + 1, _to)")).alias("copy")
    return drawn.repartition(tasks, "_owner", "_from").select(*df.columns, copies)
