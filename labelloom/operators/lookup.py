"""Joins to a side that is expected, but not known, to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.sources.session import settled

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 256 * 1024 * 1024


def fits_in_memory(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table stays below both bounds, by counting its rows and their text size."""
    size = small.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def join_lookup(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join with ``small`` copied to every task only after its size was measured.

    ``small`` is stored once and measured from there; ``stored`` says that the caller
    has done so. Past the bounds the join is left to Spark: a shuffled join whose hot
    keys the adaptive skew join splits.
    """
    kept = small if stored else settled(small)
    if fits_in_memory(kept, max_rows):
        return big.join(F.broadcast(kept), on, how)
    return big.join(kept, on, how)
