"""JSONL scans and sink.

Lines are text first, so that each caller decides what a bad line means: stop, count
it, or leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom.functions.jsontext import parse_objects, text_field
from labelloom.functions.text import stripped
from labelloom.operators.lookup import join_lookup
from labelloom.sources.bytelines import RANGE_BYTES, read_byte_lines
from labelloom.sources.session import work_path

# One short row per file split; past this number the lines are shuffled instead.
MAX_SPLITS = 1_000_000
EXAMPLE_SCHEMA = "prompt string, completion string"


def read_lines(spark: SparkSession, path: str, glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """Columns value, path, split_start and a row mark that grows within a split."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_mark"),
    )


def read_numbered_lines(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, line_no (from 1 in each file) and value of all lines below a folder.

    Lines are counted per fixed byte range of a file; the running sum of earlier ranges, one
    row each, goes back to the lines as a lookup. Files are read twice and nothing is copied;
    a line of a range that was not counted, because its file grew meanwhile, stops the job.
    """
    lines = read_byte_lines(spark, path, glob, range_bytes)
    ranges = lines.groupBy("path", "range_start").agg(F.count(F.lit(1)).alias("held"))
    earlier = W.partitionBy("path").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("path", "range_start", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    unknown = F.raise_error(F.concat(F.col("path"), F.lit(": a line of an unknown range"))).cast("bigint")
    placed = join_lookup(lines, starts, ["path", "range_start"], "left", max_rows=MAX_SPLITS)
    line_no = F.coalesce(F.col("before"), unknown) + F.col("place") + 1
    return placed.select("path", line_no.alias("line_no"), "value")


def number_lines(lines: DataFrame) -> DataFrame:
    """Add line_no, counted from 1 in each file, to lines of ``read_lines`` and its options.

    The lines are stored once and both the sizes of splits and the rows come from that
    copy, so a split plan that changes between two scans can't lose any; a line whose split
    is unknown stops the job. Rows of one file split sit together in one task in file order, so the row mark
    gives the place in the split; the running size of earlier splits gives the rest.
    Only one row per split is shuffled for that sum; it goes back to the lines as a
    lookup, so the lines themselves stay where they are.
    """
    copy = work_path(lines.sparkSession, "numbered-lines")
    lines.write.parquet(copy)
    lines = lines.sparkSession.read.schema(lines.schema).parquet(copy)
    splits = lines.groupBy("path", "split_start").agg(
        F.count("*").alias("rows"), F.min("row_mark").alias("first_mark")
    )
    earlier = W.partitionBy("path").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "path",
        "split_start",
        "first_mark",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
    )
    lost = F.raise_error(F.concat(F.col("path"), F.lit(": a line of an unknown split"))).cast("bigint")
    line_no = F.coalesce(F.col("before"), lost) + F.col("row_mark") - F.col("first_mark") + 1
    placed = join_lookup(lines, starts, ["path", "split_start"], "left", max_rows=MAX_SPLITS)
    return placed.select(
        "path", line_no.alias("line_no"), "value"
    )


def mark_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Drop blank lines; add json_ok and the text fields of object lines.

    ``prompt`` and ``completion`` are set only when they are JSON strings.
    """
    kept = lines.withColumn("_text", stripped(F.col(value))).filter(F.col("_text") != "")
    parsed = parse_objects(kept, F.col("_text"), ["prompt", "completion"], "_l")
    return parsed.select(
        *lines.columns,
        F.col("_l_json").alias("json_ok"),
        F.col("_l_object").alias("is_object"),
        *[F.when(F.col("_l_object"), text_field("_l_fields", n)).alias(n) for n in ("prompt", "completion")],
    )


def strict_examples(lines: DataFrame) -> DataFrame:
    """Examples of all lines; the first line that is not JSON stops the job.

    The message names file and line when the input carries them.
    """
    marked = mark_lines(lines)
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("path", "line_no") if c in lines.columns])
    stop = F.raise_error(F.concat(place, F.lit(": invalid JSON"))).cast("boolean")
    return marked.filter(F.when(F.col("json_ok"), F.lit(True)).otherwise(stop)).drop(
        "value", "json_ok", "is_object"
    )


def json_line(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_examples(df: DataFrame, path: str, prompt: str = "prompt", completion: str = "completion") -> None:
    """One JSON object per line, UTF-8, as many files as the input has partitions."""
    df.select(json_line(F.col(prompt).alias("prompt"), F.col(completion).alias("completion")).alias("value")).write.mode(
        "errorifexists"
    ).text(path)


def write_lines(df: DataFrame, path: str, value: str = "value") -> None:
    df.select(F.col(value).alias("value")).write.mode("errorifexists").text(path)
