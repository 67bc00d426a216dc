"""Per-run files: reports, eval results, progress snapshots and logs.

Each run has its own folder; the folder name is the run id. Run folders may lie in group
folders below the root, so that no folder has very many entries. Tasks make, list and read
the folders of runs; the driver lists the first level only.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from labelloom.functions.jsontext import parse_objects
from labelloom.sources.bytelines import open_path
from labelloom.sources.jsonl import read_numbered_lines
from labelloom.sources.session import ship_package

FORMAT = "run_texts"
GROUPS = 256
TASKS_PER_CORE = 4
# Names of the first level that one task takes at most, and bytes of texts handed on at once.
MAX_NAMES = 4096
BATCH_BYTES = 4 << 20
TEXTS = pa.schema([("run_id", pa.string()), ("body", pa.string())])


def run_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def write_run_files(rows: DataFrame, root: str, file_name: str) -> int:
    """One file per run from rows of run and value, as lines; the number of files.

    All rows of a run must sit together in one partition, in the order of their lines. Files
    are made by the tasks and get their name when they are whole, so a task that runs again
    leaves the same files. Runs are dealt to ``GROUPS`` folders.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_path(root)
        attempt, made, current, out, names = TaskContext.get().taskAttemptId(), 0, None, None, ("", "")

        def close() -> None:
            out.close()
            system.move(*names)

        for b in batches:
            if not b.num_rows:
                continue
            runs = b.column("run").dictionary_encode()
            at = runs.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            values = b.column("value").to_pylist()
            for i, j in pairwise(edges):
                name = runs.dictionary[int(at[i])].as_py()
                if name != current:
                    if out is not None:
                        close()
                    folder = f"{top}/group={zlib.crc32(name.encode()) % GROUPS}/{name}"
                    system.create_dir(folder, recursive=True)
                    names = f"{folder}/.{file_name}.{attempt}", f"{folder}/{file_name}"
                    current, out, made = name, system.open_output_stream(names[0]), made + 1
                out.write("".join([f"{v}\n" for v in values[i:j]]).encode("utf-8", "surrogatepass"))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["files"])

    rows = rows.select("run", F.coalesce("value", F.lit("")).alias("value"))
    open_path(root)[0].create_dir(open_path(root)[1], recursive=True)
    return rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


@dataclass
class _Names(InputPartition):
    names: list[str]


class _TextReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.glob = options["path"].rstrip("/"), options["glob"]
        self.grouped, self.tasks = options["grouped"] == "true", int(options["tasks"])

    def partitions(self) -> list[_Names]:
        system, top = open_path(self.root)
        names = sorted(_visible(system.get_file_info(fs.FileSelector(top)), fs.FileType.Directory, "*"))
        parts = max(1, min(len(names), max(self.tasks, -(-len(names) // MAX_NAMES))))
        return [_Names(names[k::parts]) for k in range(parts)]

    def read(self, partition: _Names) -> Iterator[pa.RecordBatch]:
        system, top = open_path(self.root)
        held: list[tuple[str, str]] = []
        size = 0
        for name in partition.names:
            for run in self._runs(system, top, name):
                for file in _visible(system.get_file_info(fs.FileSelector(run)), fs.FileType.File, self.glob):
                    with system.open_input_stream(f"{run}/{file}") as stream:
                        body = stream.read().decode("utf-8", "replace")
                    held.append((run.rsplit("/", 1)[1], body))
                    size += len(body)
                    if size > BATCH_BYTES:
                        yield _texts(held)
                        held, size = [], 0
        if held:
            yield _texts(held)

    def _runs(self, system: fs.FileSystem, top: str, name: str) -> list[str]:
        if not self.grouped:
            return [f"{top}/{name}"]
        found = system.get_file_info(fs.FileSelector(f"{top}/{name}"))
        return [f"{top}/{name}/{run}" for run in _visible(found, fs.FileType.Directory, "*")]


def _visible(found: list[fs.FileInfo], kind: fs.FileType, glob: str) -> list[str]:
    """Names of the entries of a kind that are neither hidden nor empty files."""
    names = [f.base_name for f in found if f.type == kind and (kind == fs.FileType.Directory or f.size)]
    return [n for n in names if n[0] not in "._" and fnmatch.fnmatch(n, glob)]


def _texts(held: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=TEXTS)


class RunTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "run_id string, body string"

    def reader(self, schema: StructType) -> _TextReader:
        return _TextReader(self.options)


def read_run_texts(spark: SparkSession, root: str, file_name: str, grouped: bool = False) -> DataFrame:
    """Columns run_id and body: one whole small file per run folder; empty files are left out.

    ``grouped`` says that the run folders lie in group folders, as ``write_run_files`` makes them.
    """
    ship_package(spark)
    spark.dataSource.register(RunTexts)
    reader = spark.read.format(FORMAT).option("glob", file_name).option("grouped", str(grouped).lower())
    return reader.option("tasks", TASKS_PER_CORE * spark.sparkContext.defaultParallelism).load(root)


def read_run_logs(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Columns run_id, line_no and line from one log file per run folder."""
    lines = read_numbered_lines(spark, root, glob=file_name)
    return lines.select(run_of(F.col("path")).alias("run_id"), "line_no", F.col("value").alias("line"))


def eval_results(texts: DataFrame, body: str = "body") -> DataFrame:
    """Add valid_pct and passed from the result text; a number may be quoted, any value says whether it passed.

    Text that is no object, a missing key or a share that is no number stops the job.
    """
    parsed = parse_objects(texts, F.col(body), ["valid_pct", "passed"], "_e")
    share, passed = F.col("_e_fields.valid_pct"), F.col("_e_fields.passed")
    value = F.try_variant_get(share, "$", "double")
    kind = F.schema_of_variant(passed)
    truth = (
        F.when(kind == "BOOLEAN", F.try_variant_get(passed, "$", "boolean"))
        .when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(passed, "$", "string") != "")
        .otherwise(F.coalesce(F.try_variant_get(passed, "$", "double") != 0, F.lit(True)))
    )
    whole = F.col("_e_object") & passed.isNotNull()
    stop = lambda kind: F.raise_error(F.concat(F.lit("eval result: "), F.coalesce(body, F.lit("")))).cast(kind)
    return parsed.select(
        *texts.columns,
        F.coalesce(F.when(whole, value), stop("double")).alias("valid_pct"),
        F.coalesce(F.when(whole, truth), stop("boolean")).alias("passed"),
    )


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """run_id, valid_pct and passed of result lines that carry their run id."""
    lines = spark.read.text(path).withColumn("run_id", F.get_json_object("value", "$.run_id"))
    return eval_results(lines, "value").select("run_id", "valid_pct", "passed")


def write_report(report: DataFrame, path: str) -> None:
    """Nested report as JSON."""
    report.write.mode("overwrite").json(path)
