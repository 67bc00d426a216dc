"""Registry, listing and join queries over models, runs and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.operators import listing, quality, registry, series
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources import results, store
from labelloom.sources.session import work_path

NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    """A fixed time of change, so that results can be compared."""
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


RUN_COLUMNS = ["id", "model_id", "workflow_id", "status", "eval_valid_pct", "progress", "progress_detail", "created_at", "updated_at"]
_RUN_LIST = ", ".join(RUN_COLUMNS)


def _changes(spark, sf):
    """Events as change rows; some ids are unknown to the registry."""
    return V.table(spark, sf, "events").select(
        (F.col("user_id") * 11).alias("id"), F.col("event_id").alias("seq"), "ts", "event_type", "value", "props"
    )


O.cte("changes", [], "SELECT user_id*11 AS id, event_id AS seq, ts, event_type, value, props FROM events")


@query("registry_scan", O.sql(["runs"], f"SELECT {_RUN_LIST}, true AS status_known FROM runs"))
def registry_scan(spark, sf):
    path = work_path(spark, "runs")
    V.runs(spark, sf).write.parquet(path)
    return registry.checked_runs(spark.read.parquet(path))


@query("schema_evolve", O.sql(["models"], """
SELECT id, name, CASE WHEN epochs > 2 THEN artifact ELSE '' END AS artifact, epochs > 2 AND is_active AS is_active FROM models"""))
def schema_evolve(spark, sf):
    """Old rows lack two columns; the merged table fills their declared defaults."""
    path = work_path(spark, "evolving")
    models = V.models(spark, sf)
    old, new = models.filter("epochs <= 2"), models.filter("epochs > 2")
    old.drop("artifact", "is_active").write.parquet(f"{path}/part=old")
    new.write.parquet(f"{path}/part=new")
    both = spark.read.option("mergeSchema", "true").parquet(path)
    return both.na.fill({"artifact": "", "is_active": False}).select("id", "name", "artifact", "is_active")


@query("registry_create", O.sql(["runs", "changes"], f"""
SELECT {_RUN_LIST} FROM runs UNION ALL
SELECT seq, id % 10, 'wf-'||seq, 'pending', NULL, NULL, NULL, {NOW_SQL}, {NOW_SQL} FROM changes
WHERE event_type = 'signup' AND seq NOT IN (SELECT id FROM runs)"""))
def registry_create(spark, sf):
    new = _changes(spark, sf).filter(F.col("event_type") == "signup").select(
        F.col("seq").alias("id"), (F.col("id") % 10).alias("model_id"),
        F.concat(F.lit("wf-"), F.col("seq").cast("string")).alias("workflow_id"), F.lit("pending").alias("status"),
    )
    return registry.create_rows(V.runs(spark, sf), new, now())


@query("registry_get", O.sql(["runs", "changes"], """
SELECT c.id, r.model_id, r.workflow_id, r.status FROM (SELECT DISTINCT id FROM changes) c LEFT JOIN runs r ON r.id = c.id"""))
def registry_get(spark, sf):
    return registry.get_rows(V.runs(spark, sf), _changes(spark, sf)).select("id", "model_id", "workflow_id", "status")


def _stored_runs(spark, sf):
    """The run snapshot in buckets of its id; only changes are moved to it."""
    return store.save_snapshot(V.runs(spark, sf), "runs")


@query("registry_update", O.sql(["runs", "changes"], """
SELECT r.id, coalesce(c.seq % 10, r.model_id) AS model_id, coalesce('wf-'||c.seq, r.workflow_id) AS workflow_id, r.status,
       r.created_at, coalesce(c.ts, r.updated_at) AS updated_at
FROM runs r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM changes WHERE event_type = 'signup') c
  ON c.id = r.id AND c.rn = 1"""))
def registry_update(spark, sf):
    changes = _changes(spark, sf).filter(F.col("event_type") == "signup").select(
        "id", "seq", "ts", (F.col("seq") % 10).alias("model_id"),
        F.concat(F.lit("wf-"), F.col("seq").cast("string")).alias("workflow_id"),
    )
    out = registry.update_rows(_stored_runs(spark, sf), store.aligned(changes), ["model_id", "workflow_id"])
    return out.select("id", "model_id", "workflow_id", "status", "created_at", "updated_at")


@query("registry_delete", O.sql(["runs", "changes"], """
SELECT id, status FROM runs WHERE id NOT IN (SELECT id FROM changes WHERE event_type = 'error')"""))
def registry_delete(spark, sf):
    gone = _changes(spark, sf).filter(F.col("event_type") == "error")
    return registry.delete_rows(V.runs(spark, sf), gone).select("id", "status")


@query("registry_delete_flags", O.sql(["runs", "changes"], """
SELECT DISTINCT id, id IN (SELECT id FROM runs) AS deleted FROM changes WHERE event_type = 'error'"""))
def registry_delete_flags(spark, sf):
    gone = _changes(spark, sf).filter(F.col("event_type") == "error")
    return registry.deleted_flags(V.runs(spark, sf), gone)


def _last(columns, where):
    return (f"SELECT * FROM (SELECT id, {columns}, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn "
            f"FROM changes WHERE {where}) WHERE rn = 1")


@query("registry_patch", O.sql(["runs", "changes"], """
SELECT r.id, coalesce(s.status, r.status) AS status, CASE WHEN e.id IS NULL THEN r.eval_valid_pct ELSE e.pct END AS eval_valid_pct,
       p.value AS progress, p.props AS progress_detail, r.created_at, coalesce(t.ts, r.updated_at) AS updated_at
FROM runs r LEFT JOIN s ON s.id = r.id LEFT JOIN e ON e.id = r.id LEFT JOIN p ON p.id = r.id LEFT JOIN t ON t.id = r.id""",
    s=_last("CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'evaluating' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status",
            "event_type <> 'view'"),
    e=_last("CASE WHEN event_type = 'purchase' THEN value/100 END AS pct", "event_type IN ('purchase','error')"),
    p=_last("value, props", "event_type = 'view'"),
    t=_last("ts", "true")))
def registry_patch(spark, sf):
    """Status, eval and progress patches; an error sets the eval value back to null."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending").when(kind == "click", "evaluating")
        .when(kind == "purchase", "completed").otherwise("failed")
    )
    changes = _changes(spark, sf).select(
        "id", "seq", "ts",
        status.alias("status"), (kind != "view").alias("set_status"),
        F.when(kind == "purchase", F.col("value") / 100).alias("eval_valid_pct"),
        kind.isin("purchase", "error").alias("set_eval_valid_pct"),
        F.col("value").alias("progress"), (kind == "view").alias("set_progress"),
        F.col("props").alias("progress_detail"), (kind == "view").alias("set_progress_detail"),
    )
    out = registry.patch_rows(
        _stored_runs(spark, sf), store.aligned(changes), ["status", "eval_valid_pct", "progress", "progress_detail"]
    )
    return out.select("id", "status", "eval_valid_pct", "progress", "progress_detail", "created_at", "updated_at")


@query("patch_artifact", O.sql(["models", "changes"], """
SELECT m.id, m.name, coalesce('gguf/run-'||c.seq||'.gguf.gz', m.artifact) AS artifact, coalesce(c.ts, m.updated_at) AS updated_at
FROM models m LEFT JOIN c ON c.id = m.id""", c=_last("seq, ts", "event_type = 'purchase'")))
def patch_artifact(spark, sf):
    """Artifact path of finished runs saved on their model; unknown models are skipped."""
    changes = _changes(spark, sf).filter(F.col("event_type") == "purchase").select(
        "id", "seq", "ts", F.concat(F.lit("gguf/run-"), F.col("seq").cast("string"), F.lit(".gguf.gz")).alias("artifact"),
        F.lit(True).alias("set_artifact"),
    )
    return registry.patch_rows(V.models(spark, sf), changes, ["artifact"]).select("id", "name", "artifact", "updated_at")


@query("activate_exclusive", O.sql(["models"], f"SELECT id, id = 5 AS is_active, {NOW_SQL} AS updated_at FROM models"))
def activate_exclusive(spark, sf):
    return registry.activate_only(V.models(spark, sf), F.lit(5), now()).select("id", "is_active", "updated_at")


@query("activate_unknown", O.sql(["models"], "SELECT id, is_active, updated_at FROM models"))
def activate_unknown(spark, sf):
    return registry.activate_only(V.models(spark, sf), F.lit(-1), now()).select("id", "is_active", "updated_at")


_VERDICTS = """SELECT user_id AS id, count_if(event_type <> 'error')/count(*) AS pct, max(ts) AS ts FROM events GROUP BY 1"""


def verdicts(spark, sf):
    pct = quality.ratio(F.count_if(F.col("event_type") != "error"), F.count("*"))
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        pct.alias("valid_pct"), F.max("ts").alias("ts")
    ).withColumn("passed", F.col("valid_pct") >= 0.8)


@query("finalise_runs", O.sql(["runs"], """
SELECT r.id, CASE WHEN v.pct >= 0.8 THEN 'completed' WHEN v.id IS NOT NULL THEN 'failed' ELSE r.status END AS status,
       CASE WHEN v.id IS NOT NULL THEN v.pct ELSE r.eval_valid_pct END AS eval_valid_pct, coalesce(v.ts, r.updated_at) AS updated_at
FROM runs r LEFT JOIN v ON v.id = r.id""", v=_VERDICTS))
def finalise_runs(spark, sf):
    out = registry.finalise(V.runs(spark, sf), verdicts(spark, sf))
    return out.select("id", "status", "eval_valid_pct", "updated_at")


@query("runs_current", O.sql(["run_changes"], """
SELECT run_id, seq, ts, status, progress FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM run_changes) WHERE rn = 1"""))
def runs_current(spark, sf):
    return series.current_rows(V.run_changes(spark, sf), "run_id", "seq").select("run_id", "seq", "ts", "status", "progress")


@query("runs_newest_first", O.sql(["runs"], "SELECT id, status, created_at FROM runs ORDER BY created_at DESC, id"))
def runs_newest_first(spark, sf):
    return series.newest_first(V.runs(spark, sf).select("id", "status", "created_at"))


@query("runs_by_model", O.sql(["runs"], "SELECT id, model_id, status FROM runs WHERE model_id = 3"))
def runs_by_model(spark, sf):
    return listing.by_key(V.runs(spark, sf), "model_id", 3).select("id", "model_id", "status")


@query("active_model", O.sql(["models"], "SELECT id, name FROM models WHERE is_active ORDER BY id LIMIT 1"))
def active_model(spark, sf):
    return registry.active_row(V.models(spark, sf)).select("id", "name")


@query("search_models", O.sql(["models"], """
SELECT id, name, description, base_model FROM models
WHERE contains(lower(name),'on_1') OR contains(lower(description),'on_1') OR contains(lower(base_model),'on_1')"""))
def search_models(spark, sf):
    return listing.search(V.models(spark, sf), "ON_1", ["name", "description", "base_model"]).select(
        "id", "name", "description", "base_model"
    )


@query("seed_if_absent", O.sql(["models"], """
SELECT count_if(name NOT IN (SELECT name FROM models))::BIGINT AS created, count_if(name IN (SELECT name FROM models))::BIGINT AS skipped
FROM new""", new="SELECT 'Supplier#'||lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer"))
def seed_if_absent(spark, sf):
    return registry.insert_if_absent(V.models(spark, sf).select("id", "name"), _seed_rows(spark, sf))[1]


@query("seed_if_absent_rows", O.sql(["models"], """
SELECT id, name FROM models UNION ALL SELECT NULL, name FROM new WHERE name NOT IN (SELECT name FROM models)""",
    new="SELECT 'Supplier#'||lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer"))
def seed_if_absent_rows(spark, sf):
    return registry.insert_if_absent(V.models(spark, sf).select("id", "name"), _seed_rows(spark, sf))[0]


def _seed_rows(spark, sf):
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return V.table(spark, sf, "customer").select(name.alias("name"))


@query("pending_users", O.sql(["users", "holders"], """
SELECT user_id, email FROM users u WHERE NOT EXISTS (SELECT 1 FROM holders h WHERE h.user_id = u.user_id)"""))
def pending_users(spark, sf):
    return listing.pending(V.users(spark, sf), V.role_holders(spark, sf))


@query("approved_users", O.sql(["users", "holders"], """
SELECT user_id, email FROM users u WHERE EXISTS (SELECT 1 FROM holders h WHERE h.user_id = u.user_id)"""))
def approved_users(spark, sf):
    return listing.approved(V.users(spark, sf), V.role_holders(spark, sf))


@query("union_pages", """
SELECT c_custkey AS user_id, c_name AS email FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
UNION ALL SELECT p_partkey, p_name FROM part""")
def union_pages(spark, sf):
    page = lambda name, key, mail: V.table(spark, sf, name).select(F.col(key).alias("user_id"), F.col(mail).alias("email"))
    return listing.union_pages([
        page("customer", "c_custkey", "c_name"), page("supplier", "s_suppkey", "s_name"), page("part", "p_partkey", "p_name")
    ])


@query("run_with_model", O.sql(["runs", "models"], """
SELECT r.id, r.status, m.name, m.base_model, m.epochs FROM runs r JOIN models m ON m.id = r.model_id"""))
def run_with_model(spark, sf):
    models = V.models(spark, sf).select(F.col("id").alias("model_id"), "name", "base_model", "epochs")
    return V.runs(spark, sf).join(models, "model_id").select("id", "status", "name", "base_model", "epochs")


# -- reports -----------------------------------------------------------------


def report_texts(spark, sf):
    """Report text per run: good, broken, incomplete or out of range; some runs have none."""
    c = F.col("c_custkey")
    kind = c % 6
    share = (c % 41).cast("string")

    def section(name, acc):
        return F.concat(F.lit(f'"{name}":{{"correct":'), share, F.lit(',"total":40,"accuracy":'), acc, F.lit(',"passed":true}'))

    good = F.lit("0.9")
    stats = [section(s, good) for s in C.PROMPT_STATS[:4]]
    last = F.when(kind == 1, "").otherwise(F.concat(F.lit(","), section("tiredness", good)))
    body = F.concat(
        F.lit('{"per_stat_accuracy":{'), F.concat_ws(",", *stats), last, F.lit("},"),
        section("target_accuracy", F.when(kind == 2, "1.5").otherwise("0.95")), F.lit(","),
        section("priority_conflict", good), F.lit(","), section("fallback_accuracy", good),
        F.lit(',"action_distribution":{"EAT":'), share, F.lit('},"max_action_share":0.25,"passed":true}'),
    )
    text = F.when(kind == 0, F.lit("{broken")).otherwise(body)
    texts = V.table(spark, sf, "customer")
    return texts.select(c.alias("run_id"), F.when(F.col("c_mktsegment") != "BUILDING", text).alias("body"))


def report_files(spark, sf):
    """The same texts as one file in a folder per run, read back; a run without a file has no body."""
    root, texts = work_path(spark, "reports"), report_texts(spark, sf)
    run = F.concat(F.lit("run_id="), F.col("run_id").cast("string")).alias("run")
    written = texts.filter(F.col("body").isNotNull()).select(run, F.col("body").alias("value"))
    results.write_run_files(written.repartition("run").sortWithinPartitions("run"), root, "report.json")
    found = results.read_run_texts(spark, root, "report.json", grouped=True)
    run_id = F.split_part("run_id", F.lit("="), F.lit(2)).cast("bigint").alias("run_id")
    return texts.select("run_id").join(found.select(run_id, "body"), "run_id", "left")


O.cte("reports", [], """
SELECT c_custkey AS run_id, c_custkey % 6 > 2 AND c_mktsegment <> 'BUILDING' AS good, c_custkey % 41 AS share FROM customer""")


@query("report_scan", O.sql(["reports"], """
SELECT run_id, good AS readable, CASE WHEN good THEN 0.95 END::DOUBLE AS target_accuracy, CASE WHEN good THEN share END::BIGINT AS eats FROM reports"""))
def report_scan(spark, sf):
    rows = quality.read_reports(report_files(spark, sf))
    return rows.select(
        "run_id", F.col("report").isNotNull().alias("readable"), F.col("report.target_accuracy.accuracy").alias("target_accuracy"),
        F.col("report.action_distribution")["EAT"].alias("eats"),
    )


@query("run_evaluation", O.sql(["runs", "reports"], """
SELECT r.id, r.status, r.eval_valid_pct, coalesce(good, false) AS has_report, CASE WHEN good THEN 0.25 END::DOUBLE AS max_action_share
FROM runs r LEFT JOIN reports p ON p.run_id = r.id"""))
def run_evaluation(spark, sf):
    reports = quality.read_reports(report_texts(spark, sf)).select(F.col("run_id").alias("id"), "report")
    return V.runs(spark, sf).join(reports, "id", "left").select(
        "id", "status", "eval_valid_pct", F.col("report").isNotNull().alias("has_report"), "report.max_action_share"
    )


@query("eval_results_scan", """
SELECT user_id AS run_id, count_if(event_type <> 'error')/count(*) AS valid_pct, count_if(event_type <> 'error')/count(*) >= 0.8 AS passed
FROM events GROUP BY 1""")
def eval_results_scan(spark, sf):
    path = work_path(spark, "evals")
    share = F.col("valid_pct").cast("string")
    quoted = F.when(F.col("id") % 3 == 0, F.concat(F.lit('"'), share, F.lit('"'))).otherwise(share)
    line = F.format_string('{"run_id": %s, "valid_pct": %s, "passed": %s}', F.col("id"), quoted, F.col("passed"))
    verdicts(spark, sf).select(line.alias("value")).write.text(path)
    return results.read_eval_results(spark, path).withColumn("run_id", F.col("run_id").cast("bigint"))


# -- overrides and guards ----------------------------------------------------


@query("resolve_overrides", O.sql(["models"], """
SELECT e.event_id, coalesce(e.epochs, m.epochs) AS epochs,
       CASE WHEN coalesce(e.backend, m.backend) = 'local' THEN '' ELSE coalesce(e.backend, m.backend) END AS trigger_backend,
       CASE WHEN coalesce(nullif(e.backend,''), m.backend) = 'local' THEN '' ELSE coalesce(nullif(e.backend,''), m.backend) END AS rerun_backend,
       m.id IS NOT NULL AS model_known
FROM asks e LEFT JOIN models m ON m.id = e.model_id""", asks="""
SELECT event_id, user_id AS model_id, CASE WHEN event_type = 'view' THEN (event_id % 9)::INT END AS epochs,
       CASE event_type WHEN 'signup' THEN '' WHEN 'click' THEN 'local' WHEN 'purchase' THEN 'rented' END AS backend FROM events"""))
def resolve_overrides(spark, sf):
    kind = F.col("event_type")
    asks = V.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("model_id"),
        F.when(kind == "view", (F.col("event_id") % 9).cast("int")).alias("ask_epochs"),
        F.when(kind == "signup", "").when(kind == "click", "local").when(kind == "purchase", "rented").alias("ask_backend"),
    )
    models = V.models(spark, sf).select(F.col("id").alias("model_id"), "epochs", "backend", F.lit(True).alias("known"))
    both = asks.join(models, "model_id", "left")
    ask, default = F.col("ask_backend"), F.col("backend")
    return both.select(
        "event_id",
        listing.null_override(F.col("ask_epochs"), F.col("epochs")).alias("epochs"),
        listing.local_as_empty(listing.null_override(ask, default)).alias("trigger_backend"),
        listing.local_as_empty(listing.empty_override(ask, default)).alias("rerun_backend"),
        F.coalesce("known", F.lit(False)).alias("model_known"),
    )


@query("activation_guard", O.sql(["runs", "models"], """
SELECT 'run' AS kind, id, status = 'completed' AS activatable,
       CASE WHEN status = 'completed' THEN '' ELSE 'Run has not completed successfully (status='||status||')' END AS reason FROM runs
UNION ALL SELECT 'model', id, artifact <> '', CASE WHEN artifact <> '' THEN '' ELSE 'Model has no exported artifact yet' END FROM models"""))
def activation_guard(spark, sf):
    run = V.runs(spark, sf).select(F.lit("run").alias("kind"), "id", listing.run_guard(F.col("status")).alias("reason"))
    model = V.models(spark, sf).select(F.lit("model").alias("kind"), "id", listing.model_guard(F.col("artifact")).alias("reason"))
    both = run.unionByName(model)
    return both.select("kind", "id", (F.col("reason") == "").alias("activatable"), "reason")


@query("stage_board", O.sql(["runs"], """
SELECT id, stage_no, ['Generate','Train','Evaluate','Export'][stage_no+1] AS stage,
  CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'failed' THEN CASE WHEN stage_no = 0 THEN 'failed' ELSE 'pending' END
       WHEN stage_no < pos THEN 'completed' WHEN stage_no = pos THEN 'active' ELSE 'pending' END AS state
FROM (SELECT id, status, CASE status WHEN 'generating' THEN 0 WHEN 'training' THEN 1 WHEN 'evaluating' THEN 2 WHEN 'exporting' THEN 3 ELSE -1 END AS pos FROM runs),
     (SELECT unnest([0,1,2,3]) AS stage_no)"""))
def stage_board(spark, sf):
    return listing.stage_board(V.runs(spark, sf))
