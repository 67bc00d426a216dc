"""Snapshots that stay in buckets of their key, so that a few changes move and the snapshot doesn't."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from labelloom.sources.session import work_path

BUCKETS = 16


def save_snapshot(rows: DataFrame, name: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Write rows as a table in ``buckets`` parts of the key, each sorted by it, and read it.

    Every part becomes one file, since rows are dealt to the parts first. The table's files
    lie in the shared folder; ``name`` gets a suffix that no other snapshot has.
    """
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", work_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def aligned(changes: DataFrame, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Change rows dealt as the snapshot is; reducing and joining them by key then moves nothing more."""
    return changes.repartition(buckets, key)

