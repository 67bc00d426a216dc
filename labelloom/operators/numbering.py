"""Dense numbers, running totals and carried values over a whole table in a stated order.

One range shuffle puts rows in order over many tasks, whatever their keys; that order is
written once. Each written part gives one summary row, the summaries are summed up in order,
and the rows get theirs back as a lookup, so no window ever spans the table. A written place
names its row from then on, so a repeated task numbers rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators.lookup import join_lookup
from labelloom.sources.session import work_path

MARK, PART = "_mark", "_part"
# A row mark holds the part above this bit and the place in the part below it.
MARK_BITS = 33
MAX_PARTS = 1_000_000


def _written(df: DataFrame) -> DataFrame:
    """Rows written as they are with ``_mark``, which from then on is fixed."""
    path = work_path(df.sparkSession, "ordered")
    df.withColumn(MARK, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.schema(df.select("*", F.lit(0).cast("bigint").alias(MARK)).schema).parquet(path)


def in_written_order(df: DataFrame, *order: str | Column, many_ties: bool = False) -> DataFrame:
    """Rows written in order with ``_mark``, which grows with it, and ``_part``.

    Rows that tie come in any order, which the written table then fixes, and meet in one task.
    With ``many_ties`` they are first written as they come, and that order spreads them.
    """
    if many_ties:
        df = _written(df).withColumnRenamed(MARK, "_tie")
        order = (*order, "_tie")
    rows = _written(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return rows.withColumn(PART, F.shiftright(MARK, MARK_BITS)).drop("_tie")


def _before(summaries: DataFrame, value: Column) -> Column:
    """Total of the parts before; there is one row per part."""
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def numbered(df: DataFrame, *order: str | Column, name: str = "place", many_ties: bool = False) -> DataFrame:
    """Add dense numbers 0 .. n-1 in the order; rows that tie are numbered in any order."""
    rows = in_written_order(df, *order, many_ties=many_ties)
    parts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_held"))
    starts = parts.select(PART, _before(parts, F.col("_held")).alias("_before"))
    place = F.col("_before") + F.col(MARK).bitwiseAND((1 << MARK_BITS) - 1)
    found = join_lookup(rows, starts, PART, "inner", max_rows=MAX_PARTS)
    return found.select(*df.columns, place.alias(name))


def with_starts(ordered: DataFrame, value: str, name: str) -> DataFrame:
    """Add the total of ``value`` over all earlier rows of ``in_written_order``."""
    parts = ordered.groupBy(PART).agg(F.sum(value).alias("_held"))
    starts = parts.select(PART, _before(parts, F.col("_held")).alias("_before"))
    earlier = W.partitionBy(PART).orderBy(MARK).rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    found = join_lookup(ordered.withColumn("_within", within), starts, PART, "inner", max_rows=MAX_PARTS)
    return found.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def carried(ordered: DataFrame, value: str) -> DataFrame:
    """Fill nulls of ``value`` with the last one before, over all rows of ``in_written_order``."""
    known = F.when(F.col(value).isNotNull(), F.col(MARK))
    parts = ordered.groupBy(PART).agg(F.max_by(value, known).alias("_last"))
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    lasts = parts.select(PART, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    so_far = W.partitionBy(PART).orderBy(MARK).rowsBetween(W.unboundedPreceding, 0)
    within = F.last(value, ignorenulls=True).over(so_far)
    found = join_lookup(ordered.withColumn("_within", within), lasts, PART, "inner", max_rows=MAX_PARTS)
    return found.withColumn(value, F.coalesce("_within", "_carry")).drop("_within", "_carry")


def zip_rows(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Pair two tables by position, each in its own order; rows beyond the shorter one are left out.

    Columns are ``place`` and the structs ``left`` and ``right``, so names may clash.
    """
    sides = []
    for name, df, order in (("left", left, left_order), ("right", right, right_order)):
        rows = df.select(F.struct("*").alias(name))
        sides.append(numbered(rows, *[F.col(f"{name}.{c}") for c in order]))
    return sides[0].join(sides[1], "place")
