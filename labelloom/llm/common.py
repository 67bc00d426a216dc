"""Small helpers that the operators of this subpackage share.

Input rules hold for every operator unless its docstring says otherwise: a null text
counts as empty, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.session import ship_package, work_path

SPACES = "[\\x20\\x09-\\x0D]+"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWER = bytes.maketrans(LETTERS[0].encode(), LETTERS[1].encode())

# Texts of one slice stay below this size, so that a task's memory is bounded.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, with null texts as empty ones."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Rows written once in the shared folder and read from there; cuts the lineage."""
    path = work_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return reread(df.sparkSession, path, df)


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove folders of ours that are no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def least_hashed(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of the columns.

    A threshold, from the number of rows, drops most others where they are, so what all tasks
    together send on stays near ``rows`` however many tasks there are. Reads ``df`` twice.
    """
    place = F.xxhash64(*columns)
    share = (1.2 * rows + 1000) / max(1, df.count())
    if share < 1:
        df = df.filter(place < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(place).limit(rows)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts take about ``limit`` bytes at most, at least one row each."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = taken = 0
        for i, size in enumerate(sizes):
            if taken and taken + size > limit:
                yield batch.slice(first, i - first)
                first, taken = i, 0
            taken += size
        if first < batch.num_rows:
            yield batch.slice(first)
