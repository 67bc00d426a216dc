"""Session settings and shared working folders."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "labelloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew joins and UTC time; keeps an existing one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    Needed where it is not installed on the executors. Spark copies the archive to them.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="labelloom-"), "labelloom")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "labelloom"))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the cluster names.

    Only a local master without one (tests) gets a folder of our own; a cluster must name it.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if not context.master.split("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="labelloom-")
    context.setCheckpointDir(own)
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """Rows stored reliably in the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
