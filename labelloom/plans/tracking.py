"""Run state, progress and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.text import first_number_in_parens, slug
from labelloom.operators import series, tracking
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources import results
from labelloom.sources.session import work_path


@query("progress_normalise", O.sql(["progress", "host_progress"], """
SELECT event_id, p.run_id, p.fraction, p.detail, h.detail AS host_detail FROM progress p JOIN host_progress h USING (event_id)"""))
def progress_normalise(spark, sf):
    rows = tracking.normalise_progress(V.progress_snapshots(spark, sf))
    host = tracking.normalise_progress(rows.withColumnRenamed("detail", "_d").drop("fraction"), source="host")
    return host.select("event_id", "run_id", "fraction", F.col("_d").alias("detail"), F.col("detail").alias("host_detail"))


@query("latest_progress", O.sql(["host_progress"], """
SELECT run_id, ts, fraction, detail FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM host_progress
  WHERE run_id % 3 = 0 OR fraction > 0) WHERE rn = 1"""))
def latest_progress(spark, sf):
    rows = V.progress_snapshots(spark, sf).withColumn("is_local", F.col("run_id") % 3 == 0)
    return tracking.latest_progress(tracking.normalise_progress(rows, source="host"))


_PODS = ["CREATED", "RUNNING", "EXITED", "FAILED", "TERMINATED", "OTHER"]
_INSTANCES = ["created", "loading", "running", "exited", "stopped", "other"]
_TEXTS = ["Kernel is COMPLETE", "status: error, complete", "Failed", "now running", "queued", "CancelAcknowledged", "unknown"]
_FILES = [" Done\n", "RUNNING", "weird", "failed", "pending"]
_PREFIXES = ["vastai/", "runpod/", "kaggle/", "ssh/", "colab/", "other/", ""]


def _nth(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


@query("run_dimensions", """
WITH r AS (SELECT event_id, event_id % 6 AS k6, event_id % 7 AS k7, event_id % 5 AS k5, event_id % 4 AS k4, user_id,
  CASE WHEN event_id % 9 = 0 THEN '???' ELSE event_type||' Run #'||event_id||' '||props END AS name FROM events)
SELECT event_id, ['pending','running','pending','failed','failed','pending'][k6+1] AS pod_state,
  ['pending','pending','running','pending','pending','pending'][k6+1] AS instance_state,
  ['done','done','failed','running','pending','failed','pending'][k7+1] AS text_state,
  ['done','running','pending','failed','pending'][k5+1] AS file_state,
  ['vastai','runpod','kaggle','ssh','colab','',''][k7+1] AS backend,
  coalesce(nullif(left(trim(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'-'),50),''),'model') AS slug,
  CASE k4 WHEN 0 THEN 'gguf/'||name||'.gguf.gz' WHEN 1 THEN 'workflow/'||event_id||'/model.gguf.gz'
          WHEN 2 THEN 'gguf/'||user_id||'.gguf.gz' ELSE 'models/out.gguf.gz' END AS artifact_key FROM r""")
def run_dimensions(spark, sf):
    """States, backend, slug and artifact key of each run record."""
    e = F.col("event_id")
    name = F.when(e % 9 == 0, "???").otherwise(
        F.concat("event_type", F.lit(" Run #"), e.cast("string"), F.lit(" "), "props")
    )
    rows = V.table(spark, sf, "events").select("event_id", "user_id", name.alias("name"))
    run = F.concat(_nth(_PREFIXES, e), F.col("user_id").cast("string"))
    empty = F.lit(None).cast("string")
    key = tracking.artifact_key(
        F.when(e % 4 == 0, F.col("name")).otherwise(""),
        F.when(e % 4 == 1, e.cast("string")).otherwise(empty),
        F.when(e % 4 == 2, F.col("user_id").cast("string")).otherwise(""),
        F.lit("models/out.gguf.gz"),
    )
    return rows.select(
        "event_id",
        tracking.mapped_state(_nth(_PODS, e), C.POD_STATES).alias("pod_state"),
        tracking.mapped_state(_nth(_INSTANCES, e), C.INSTANCE_STATES).alias("instance_state"),
        tracking.keyword_state(_nth(_TEXTS, e)).alias("text_state"),
        tracking.file_state(_nth(_FILES, e)).alias("file_state"),
        tracking.backend_of(run).alias("backend"),
        slug(F.col("name")).alias("slug"),
        key.alias("artifact_key"),
    )


@query("resolve_status", """
WITH r AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_custkey % 4 AS f, c_custkey % 6 AS a, c_acctbal > 0 AS alive, c_nationkey > 12 AS ckpt FROM customer)
SELECT id, CASE WHEN seg = 'BUILDING' AND f = 0 THEN 'done' WHEN seg = 'BUILDING' AND f = 1 THEN 'running' WHEN seg = 'BUILDING' AND f = 3 THEN 'pending'
     WHEN seg <> 'HOUSEHOLD' THEN ['pending','running','pending','failed','failed','pending'][a+1] ELSE 'pending' END AS state,
   CASE WHEN alive THEN 'running' WHEN ckpt THEN 'done' ELSE 'failed' END AS session_state FROM r""")
def resolve_status(spark, sf):
    """Status files and provider states, each known for some runs only."""
    c = V.table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    k = F.col("id")
    files = c.filter(F.col("c_mktsegment") == "BUILDING").select(
        "id", _nth([" done\n", "running", "weird", "pending"], k).alias("file")
    )
    api = c.filter(F.col("c_mktsegment") != "HOUSEHOLD").select(
        "id", tracking.mapped_state(_nth(_PODS, k), C.POD_STATES).alias("api")
    )
    runs = c.select("id", (F.col("c_acctbal") > 0).alias("alive"), (F.col("c_nationkey") > 12).alias("ckpt"))
    return runs.join(files, "id", "left").join(api, "id", "left").select(
        "id",
        tracking.resolved_state(F.col("file"), F.col("api")).alias("state"),
        tracking.session_state(F.col("alive"), F.col("ckpt")).alias("session_state"),
    )


RUN_DOCUMENTS = 50


@query("log_scan", O.sql(["log_lines"], f"""
SELECT run_id, count(*)::BIGINT AS lines, sum(('0x'||substr(md5(line_no||':'||line),1,8))::BIGINT)::BIGINT AS digest FROM (
  SELECT run_id // {RUN_DOCUMENTS} AS run_id, line, row_number() OVER (PARTITION BY run_id // {RUN_DOCUMENTS} ORDER BY run_id, pos) AS line_no
  FROM log_lines) GROUP BY 1"""))
def log_scan(spark, sf):
    """One log file per run (``RUN_DOCUMENTS`` documents each), read back with line numbers."""
    path = work_path(spark, "logs")
    run = F.floor(F.col("run_id") / RUN_DOCUMENTS).alias("run")
    rows = V.log_lines(spark, sf).select(run, F.col("run_id").alias("doc"), "pos", F.col("line").alias("value"))
    ordered = rows.repartition("run").sortWithinPartitions("run", "doc", "pos")
    results.write_run_files(ordered.select(F.concat(F.lit("run="), F.col("run").cast("string")).alias("run"), "value"), path, "logs.txt")
    lines = results.read_run_logs(spark, path, "*.txt")
    word = F.conv(F.substring(F.md5(F.concat(F.col("line_no").cast("string"), F.lit(":"), "line")), 1, 8), 16, 10).cast("bigint")
    run_id = F.split_part("run_id", F.lit("="), F.lit(2)).cast("bigint").alias("run_id")
    return lines.groupBy(run_id).agg(F.count("*").alias("lines"), F.sum(word).alias("digest"))


@query("log_tail", O.sql(["log_lines"], """
SELECT run_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS rn FROM log_lines) WHERE rn <= 50"""))
def log_tail(spark, sf):
    return series.tail(V.log_lines(spark, sf), "run_id", "pos", 50)


@query("log_denoise", O.sql(["log_lines"], """
SELECT run_id, pos, line FROM log_lines WHERE NOT contains(line,'remote port forwarding failed') AND NOT contains(line,'Permanently added')"""))
def log_denoise(spark, sf):
    return tracking.denoise(V.log_lines(spark, sf))


@query("parse_valid_pct", O.sql(["log_lines"], """
SELECT run_id, arg_min(try_cast(trim(split_part(split_part(line,'(',2),'%',1)) AS DOUBLE)/100, pos) AS valid_pct
FROM log_lines WHERE starts_with(line,'Valid:') AND contains(line,'(') AND contains(line,'%)') GROUP BY run_id"""))
def parse_valid_pct(spark, sf):
    """Share from each whole log text."""
    d = V.table(spark, sf, "documents")
    k = (F.col("doc_id") % 41).cast("string")
    text = F.concat("text", F.lit("\nWarning: Permanently added host\nValid: "), k, F.lit("/40 ("), k, F.lit(".5%)  [DONE]"))
    return d.select(F.col("doc_id").alias("run_id"), first_number_in_parens(text).alias("valid_pct"))
