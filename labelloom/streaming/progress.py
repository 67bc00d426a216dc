"""Progress and state feeds as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from labelloom.functions import constants as C
from labelloom.operators.series import in_utc, utc_clock
from labelloom.operators.tracking import denoise, normalise_progress
from labelloom.sources.session import work_path

SNAPSHOT_FILE_SCHEMA = "run_id bigint, ts timestamp, event_id bigint, body string"
WATERMARK = "10 minutes"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a parquet table, given as one file or as a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


def read_snapshot_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots arriving as JSON files."""
    return spark.readStream.schema(SNAPSHOT_FILE_SCHEMA).json(folder)


def land_snapshots(spark: SparkSession, folder: str, landed: str, state: str, archive: str | None = None) -> None:
    """Move snapshot files that are there now to ``landed``: whole rows to good/, torn texts to torn/.

    A line that is no JSON object with a run and a time is torn; it is kept with its path. A
    micro-batch that is repeated writes its folders again, so nothing is doubled. ``archive``
    is where Spark then puts files that have been read.
    """
    reader = spark.readStream
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    row = F.from_json("value", SNAPSHOT_FILE_SCHEMA)

    def split(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.withColumn("row", row)
        whole = F.col("row.run_id").isNotNull() & F.col("row.ts").isNotNull()
        parsed.filter(whole).select("row.*").write.mode("overwrite").parquet(f"{landed}/good/batch={batch_id}")
        parsed.filter(F.trim("value") != "").filter(~whole | whole.isNull()).select("path", "value").write.mode(
            "overwrite"
        ).parquet(f"{landed}/torn/batch={batch_id}")

    drain(lines.writeStream.foreachBatch(split).option("checkpointLocation", state))


def read_landed(spark: SparkSession, landed: str) -> DataFrame:
    """Stream of the whole snapshots in a landing folder."""
    return spark.readStream.schema(SNAPSHOT_FILE_SCHEMA).parquet(f"{landed}/good/*")


def read_torn(spark: SparkSession, landed: str) -> DataFrame:
    return spark.read.schema("path string, value string").parquet(f"{landed}/torn/*")


def drain(writer: DataStreamWriter) -> None:
    """Run a stream over everything that is there now, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


class Sink:
    """A parquet table in the shared folder that a stream is drained into, again after each delivery."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.out, self.state = work_path(spark, f"{name}-rows"), work_path(spark, f"{name}-state")

    def drain(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        """Take all that is there now, from where the last drain ended, and read the table."""
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", self.out)
        drain(writer.option("checkpointLocation", self.state))
        return stream.sparkSession.read.schema(stream.schema).parquet(self.out)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a parquet table in the shared folder and read it."""
    return Sink(stream.sparkSession, name).drain(stream, mode)


def progress_stream(snapshots: DataFrame, source: str = "notebook", once: bool = False) -> DataFrame:
    """Snapshots with fraction and detail. ``once`` drops deliveries repeated within the watermark."""
    rows = snapshots
    if once:
        rows = rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    return normalise_progress(rows, source=source).drop("body")


def update_log(aggregate: DataFrame, name: str) -> DataFrame:
    """Append-only table of the groups that changed in each trigger.

    A repeated batch writes its folder again, so no row is doubled.
    """
    spark = aggregate.sparkSession
    out = work_path(spark, f"{name}-log")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(
        aggregate.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", work_path(spark, f"{name}-state"))
    )
    return spark.read.schema(aggregate.schema).parquet(out).drop("batch")


def latest_progress_log(snapshots: DataFrame, name: str) -> DataFrame:
    """Change log of the newest progress per run; read it with ``current_progress``.

    Remote snapshots count only above zero, local ones always. An older snapshot that
    arrives late never replaces a newer one. One row per run stays for ever; see
    ``stateful.newest_progress`` for state that silent runs lose.
    """
    newest = shown_progress(snapshots).groupBy("run_id").agg(
        F.max_by(F.struct("ts", "event_id", "fraction", "detail"), F.struct("ts", "event_id")).alias("p")
    )
    return update_log(newest.select("run_id", "p.ts", "p.event_id", "p.fraction", "p.detail"), name)


def shown_progress(snapshots: DataFrame) -> DataFrame:
    """Normalised snapshots that a run's owner sees: remote ones only above zero, local ones always."""
    return normalise_progress(snapshots, source="host").filter(F.col("is_local") | (F.col("fraction") > 0))


def current_progress(log: DataFrame) -> DataFrame:
    best = log.groupBy("run_id").agg(
        F.max_by(F.struct("ts", "fraction", "detail"), F.struct("ts", "event_id")).alias("p")
    )
    return best.select("run_id", "p.ts", "p.fraction", "p.detail")


def terminal_log(states: DataFrame, name: str) -> DataFrame:
    """Change log of the first terminal state per run; later states do not matter.

    States are reduced before the shuffle and one small row per run is kept, so a run
    that reports very often is no hot spot.
    """
    ended = states.filter(F.col("state").isin(C.TERMINAL_STATES))
    first = ended.groupBy("run_id").agg(F.min(F.struct("ts", "seq", "state")).alias("s"))
    return update_log(first.select("run_id", "s.ts", "s.seq", "s.state"), name)


def current_terminal(log: DataFrame) -> DataFrame:
    first = log.groupBy("run_id").agg(F.min(F.struct("ts", "seq", "state")).alias("s"))
    return first.select("run_id", "s.ts", "s.seq", "s.state")


def heartbeat_sessions(beats: DataFrame, timeout_seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Closed sessions of beats; a session without a terminal state is a lost run.

    ``build_session`` has beats merged to sessions in each input partition first, so a run
    that beats very often sends few rows to its task.
    """
    zoneless = beats.schema["ts"].dataType.typeName() == "timestamp_ntz"
    sessions = (
        beats.withColumn("ts", in_utc(F.col("ts")) if zoneless else F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy("run_id", F.session_window("ts", f"{timeout_seconds} seconds").alias("w"))
        .agg(F.count("*").alias("beats"), F.max(F.col("state").isin(C.TERMINAL_STATES)).alias("finished"))
    )
    start, end = (utc_clock(F.col(f"w.{n}")).alias(n) for n in ("start", "end"))
    return sessions.select("run_id", start, end, "beats", "finished")


def log_stream(lines: DataFrame) -> DataFrame:
    """Log feed without transport noise; stateless."""
    return denoise(lines)
