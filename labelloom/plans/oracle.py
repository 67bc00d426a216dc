"""Plain SQL twins of the workload tables, for checks in another engine.

Each entry is a common table expression with the names it builds on; ``sql`` puts
together those that a query needs. They are written with row-level joins and windows
on purpose: a second way to the same rows.
"""

from __future__ import annotations

from labelloom.functions import constants as C

TYPES = "['bowl','bed','toy','player','pet']"
STAT_FORMULAS = {"hunger": (37, 11), "boredom": (53, 29), "social": (71, 43), "toilet": (89, 61), "tiredness": (97, 7)}


def draw(seed: object, key: str, tag: str) -> str:
    """Uniform draw; ``tag`` is an SQL expression."""
    return f"(('0x'||substr(md5('{seed}:'||{key}||':'||{tag}),1,8))::UBIGINT/4294967296.0)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ",".join(text(v) for v in values) + "]"


def values(rows: list[tuple], names: str) -> str:
    body = ",".join("(" + ",".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


def rounded(expr: str, places: int) -> str:
    return f"printf('%.{places}f', {expr})::DOUBLE"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: list[str], body: str, **local: str) -> str:
    """Query text with the needed table expressions, then the ``local`` ones in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in CTES[name][0]:
            add(need)
        done.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in done] + [f"{n} AS ({q})" for n, q in local.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


# -- rules -------------------------------------------------------------------

cte("label_order", [], values([(s, i) for i, s in enumerate(C.LABEL_STATS)], "stat, ord"))
cte("prompt_order", [], values([(s, i) for i, s in enumerate(C.PROMPT_STATS)], "stat, ord"))
cte("stat_actions", [], values(
    [(s, i, a, len(acts)) for s, acts in C.STAT_ACTIONS.items() for i, a in enumerate(acts)], "stat, idx, action, n"))
cte("stat_types", [], values([(s, i, t) for s, ts in C.STAT_TYPES.items() for i, t in enumerate(ts)], "stat, idx, type"))
cte("action_types", [], values([(a, t) for a, ts in C.ACTION_TYPES.items() for t in ts], "action, type"))
cte("all_actions", [], values([(a, i) for i, a in enumerate(C.ACTIONS)], "action, ord"))

# -- requests ----------------------------------------------------------------

cte("requests", [], "SELECT o_orderkey AS request_id, o_orderkey % 10001 AS tick, "
    + ", ".join(f"((o_orderkey*{f}+{s})%101)::DOUBLE/100 AS {n}" for n, (f, s) in STAT_FORMULAS.items())
    + " FROM orders")
cte("objects", [], f"""
SELECT o_orderkey AS request_id, i AS pos, 'obj_'||i AS id,
       {TYPES}[((o_orderkey*(i+3)+o_custkey*(i*2+1)) % 5)+1] AS type,
       ((o_orderkey*13+i*i*29+o_custkey*i*7) % 50 + 2)::DOUBLE/2 AS distance
FROM orders, unnest(range(o_custkey % 6)) AS r(i)""")


def label_ctes(prefix: str, requests: str, objects: str, seed: str | None = None) -> None:
    """long stats, dominant stat, nearest fitting object and label of a request table."""
    cte(f"{prefix}stats", [requests], " UNION ALL ".join(
        f"SELECT request_id, '{s}' AS stat, {s} AS value FROM {requests}" for s in C.LABEL_STATS))
    cte(f"{prefix}top", [f"{prefix}stats", "label_order"], f"""
SELECT request_id, stat, value FROM (
  SELECT s.*, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, ord) AS rn
  FROM {prefix}stats s JOIN label_order USING (stat)) WHERE rn = 1""")
    cte(f"{prefix}nearest", [f"{prefix}top", objects, "stat_types"], f"""
SELECT request_id, id FROM (
  SELECT t.request_id, o.id, row_number() OVER (PARTITION BY t.request_id ORDER BY o.distance, o.pos) AS rn
  FROM {prefix}top t JOIN stat_types s USING (stat) JOIN {objects} o ON o.request_id = t.request_id AND o.type = s.type)
WHERE rn = 1""")
    pick = "a.idx = 0" if seed is None else f"a.idx = floor({draw(seed, 't.request_id', text('action'))} * a.n)"
    cte(f"{prefix}labels", [requests, f"{prefix}top", f"{prefix}nearest", "stat_actions"], f"""
SELECT t.request_id, t.stat, t.value,
       CASE WHEN t.value < 0.5 OR (t.stat <> 'toilet' AND n.id IS NULL)
            THEN CASE WHEN r.tick % 2 = 0 THEN 'IDLE' ELSE 'EXPLORE' END ELSE a.action END AS action,
       CASE WHEN t.value >= 0.5 AND t.stat <> 'toilet' THEN n.id END AS target_object_id,
       {rounded("CASE WHEN t.value < 0.5 THEN 1 - t.value ELSE t.value END", 4)} AS confidence
FROM {prefix}top t JOIN {requests} r USING (request_id) LEFT JOIN {prefix}nearest n USING (request_id)
JOIN stat_actions a ON a.stat = t.stat AND {pick}""")


def prompt_ctes(prefix: str, requests: str, objects: str, seed: object) -> None:
    cte(f"{prefix}allowed", [requests, objects, "all_actions", "action_types"], f"""
SELECT r.request_id, a.action, a.ord FROM {requests} r CROSS JOIN all_actions a
WHERE a.action IN ('TOILET','IDLE','EXPLORE') OR EXISTS (
  SELECT 1 FROM {objects} o JOIN action_types t ON t.type = o.type
  WHERE o.request_id = r.request_id AND t.action = a.action)""")
    cte(f"{prefix}stats_text", [f"{prefix}stats", "prompt_order"], f"""
SELECT request_id, string_agg(stat||'='||printf('%.2f',value)||CASE WHEN rn=1 THEN ' (highest)' ELSE '' END, ', ' ORDER BY rn) AS stats_text,
       max(CASE WHEN rn=1 THEN stat END) AS highest
FROM (SELECT s.*, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, ord) AS rn
      FROM {prefix}stats s JOIN prompt_order USING (stat)) GROUP BY request_id""")
    cte(f"{prefix}scene_text", [objects], f"""
SELECT request_id, string_agg(type||'(id='||id||',dist='||printf('%.1f',distance)||')', ', ' ORDER BY distance, pos) AS scene_text
FROM {objects} GROUP BY request_id""")
    cte(f"{prefix}actions_text", [f"{prefix}allowed"], f"""
SELECT request_id, string_agg(action, ', ' ORDER BY md5('{seed}:'||request_id||':'||action), action) AS actions_text
FROM {prefix}allowed GROUP BY request_id""")
    lines = [
        text(C.PROMPT_INTRO),
        text(C.PROMPT_STATS_HEAD) + "||stats_text",
        text(C.PROMPT_RULE),
        text(C.PROMPT_GUIDE),
        text(C.PROMPT_SCENE_HEAD) + "||coalesce(scene_text,'empty')",
        text(C.PROMPT_ACTIONS_HEAD) + "||actions_text",
        text(C.PROMPT_TAIL),
    ]
    cte(f"{prefix}prompts", [f"{prefix}stats_text", f"{prefix}scene_text", f"{prefix}actions_text"], f"""
SELECT request_id, highest, {"||chr(10)||".join(lines)} AS prompt
FROM {prefix}stats_text JOIN {prefix}actions_text USING (request_id) LEFT JOIN {prefix}scene_text USING (request_id)""")
    cte(f"{prefix}examples", [f"{prefix}prompts", f"{prefix}labels"], f"""
SELECT request_id, highest, prompt, l.stat, l.action, l.target_object_id, l.confidence,
       '{{"stat":"'||l.stat||'","action":"'||l.action||'"'||
       CASE WHEN l.target_object_id IS NULL THEN '' ELSE ',"target_object_id":"'||l.target_object_id||'"' END||
       ',"confidence":'||l.confidence||'}}' AS completion
FROM {prefix}prompts JOIN {prefix}labels l USING (request_id)""")


label_ctes("", "requests", "objects")
prompt_ctes("", "requests", "objects", C.DATA_SEED)

# -- flat objects ------------------------------------------------------------

cte("flat_objects", [], f"""
SELECT l_orderkey AS request_id, 'obj_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey AS id,
       {TYPES}[(l_partkey % 5)+1] AS type, l_quantity AS distance,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
FROM lineitem""")
label_ctes("flat_", "requests", "flat_objects")

# -- examples as lines -------------------------------------------------------

cte("lines", ["examples"], """
SELECT request_id, request_id % 50 AS kind, prompt, completion, action FROM examples""")
# What each kind of line holds: not JSON (0, 5), blank (1, 2), no object (3, 4), object completion (6),
# no marker in the prompt (7), unknown action (8); all others are good.

# -- answers -----------------------------------------------------------------

cte("raw_responses", [], """
SELECT event_id, event_id AS request_id, CASE event_id % 12
  WHEN 0 THEN '{"action": "IDLE"}'
  WHEN 1 THEN 'Here you go: {"action": "EAT", "target_object_id": "obj_'||(event_id % 7)||'", "confidence": 0.75} - done'
  WHEN 2 THEN '{action: IDLE}'
  WHEN 3 THEN '{"target_object_id": "obj_1"}'
  WHEN 4 THEN 'no idea what to do about '||props
  WHEN 5 THEN '{"action": "FLY"}'
  WHEN 6 THEN '{"action":"FETCH","target_object_id":"obj_2","confidence":0.8,"confidence":0.8,"conf'
  WHEN 7 THEN '{"target_object_id":"obj_3","confidence":0.8,"confid'
  WHEN 8 THEN '{"meta":{"v":1},"action":"EAT"}'
  WHEN 9 THEN '{"action":"SLEEP","target_object_id":5}'
  WHEN 10 THEN '{"stat":"social","action":"SOCIAL","target_object_id":null,"confidence":1}'
  ELSE '{"stat":"toilet","action":"TOILET","confidence":0.5}' END AS raw
FROM events""")
cte("flat_json", ["raw_responses"], """
SELECT *, nullif(regexp_extract(raw, '\\{[^{}]*\\}'), '') AS js,
       nullif(regexp_extract(raw, '"action"\\s*:\\s*"([A-Z]+)"', 1), '') AS pa,
       nullif(regexp_extract(raw, '"target_object_id"\\s*:\\s*"([^"]+)"', 1), '') AS pt
FROM raw_responses""")
cte("judged_json", ["flat_json"], f"""
SELECT event_id, request_id, raw, pa, pt, js,
  CASE WHEN NOT found THEN CASE WHEN pa IS NULL THEN 'no_json' WHEN list_contains({array(C.ACTIONS)}, pa) THEN 'ok_truncated' ELSE 'bad_partial' END
  WHEN NOT good THEN 'bad_json'
  WHEN coalesce(json_type(js,'$.action'),'') = 'VARCHAR' AND list_contains({array(C.ACTIONS)}, json_extract_string(js,'$.action'))
   AND coalesce(json_type(js,'$.stat'),'NULL') IN ('NULL','VARCHAR')
   AND coalesce(json_type(js,'$.target_object_id'),'NULL') IN ('NULL','VARCHAR')
   AND coalesce(json_type(js,'$.confidence'),'NULL') IN ('NULL','DOUBLE','UBIGINT','BIGINT') THEN 'ok'
  ELSE 'bad_schema' END AS status
FROM (SELECT event_id, request_id, raw, pa, pt, js IS NOT NULL AS found, json_valid(js) AS good,
             CASE WHEN json_valid(js) THEN js ELSE '{{}}' END AS js FROM flat_json)""")
cte("answers", ["judged_json"], """
SELECT event_id, request_id, raw, status,
  CASE WHEN status='ok' THEN json_extract_string(js,'$.stat') END AS stat,
  CASE WHEN status='ok' THEN json_extract_string(js,'$.action') WHEN status='ok_truncated' THEN pa END AS action,
  CASE WHEN status='ok' THEN json_extract_string(js,'$.target_object_id') WHEN status='ok_truncated' THEN pt END AS target_object_id,
  CASE WHEN status='ok' THEN json_extract_string(js,'$.confidence')::DOUBLE END AS confidence
FROM judged_json""")
cte("repaired", ["answers", "requests", "objects", "action_types"], """
SELECT a.event_id, a.request_id, a.status, CASE WHEN fix THEN NULL ELSE stat END AS stat, a.action,
       CASE WHEN fix THEN best ELSE target_object_id END AS target_object_id, confidence, fix AS repaired
FROM (
  SELECT a.*, n.id AS best, n.id IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM objects o JOIN action_types t ON t.type = o.type
      WHERE o.request_id = a.request_id AND t.action = a.action AND o.id = a.target_object_id) AS fix
  FROM answers a JOIN requests r USING (request_id)
  LEFT JOIN (SELECT request_id, action, id FROM (
      SELECT o.request_id, t.action, o.id,
             row_number() OVER (PARTITION BY o.request_id, t.action ORDER BY o.distance, o.pos) AS rn
      FROM objects o JOIN action_types t ON t.type = o.type) WHERE rn = 1) n
    ON n.request_id = a.request_id AND n.action = a.action) a""")

# -- registry ----------------------------------------------------------------

DAY0 = "TIMESTAMP '2024-01-01 00:00:00'"
cte("runs", [], f"""
SELECT c_custkey AS id, c_nationkey::BIGINT AS model_id, 'training-'||c_custkey AS workflow_id,
       {array(C.RUN_STATUSES)}[(c_custkey % 8)+1] AS status,
       CASE WHEN c_custkey % 8 > 5 THEN c_acctbal/10000 END AS eval_valid_pct,
       NULL::DOUBLE AS progress, NULL::VARCHAR AS progress_detail,
       {DAY0} + to_seconds(c_custkey % 86400) AS created_at, {DAY0} + to_seconds(c_custkey % 86400) AS updated_at
FROM customer""")
cte("run_changes", [], """
SELECT user_id AS run_id, user_id % 10 AS model_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'training' WHEN 'click' THEN 'evaluating'
                       WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'view' THEN value END AS progress
FROM events""")
cte("models", [], f"""
SELECT s_suppkey AS id, s_name AS name, n_name AS description, 'base-'||(s_nationkey % 4) AS base_model,
       (s_suppkey % 5 + 1)::INT AS epochs,
       CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'local' ELSE 'cluster' END AS backend,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'gguf/'||s_name END AS artifact, s_suppkey = 3 AS is_active,
       {DAY0} + to_seconds(s_suppkey % 86400) AS created_at, {DAY0} + to_seconds(s_suppkey % 86400) AS updated_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
cte("users", [], "SELECT c_custkey AS user_id, c_name AS email FROM customer")
cte("holders", [], "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderpriority = '1-URGENT'")

# -- tracking ----------------------------------------------------------------

cte("snapshots", [], """
SELECT user_id AS run_id, ts, event_id, CASE WHEN event_id % 24 IN (3, 7, 11, 15) THEN event_id % 24 + 100 ELSE event_id % 4 END AS shape, event_id % 50 AS step, event_id % 5 AS f, event_id % 3 AS st,
       event_id % 900 AS el, event_id % 97 AS ls FROM events""")


def progress_cte(name: str, source: str) -> None:
    steps = "'epoch=1.5  loss='||printf('%.4f', ('0.'||ls)::DOUBLE)"
    none = "'epoch=?  eval_loss=0.2500'"
    bare, lossy, halfway = "'epoch=?'", "'epoch=?  loss=0.5000'", "'epoch=?'"
    if source == "notebook":
        steps = "'step='||step||'/50  epoch=1.5  elapsed='||el||'s  loss='||printf('%.4f', ('0.'||ls)::DOUBLE)"
        none = "'step='||step||'/0  epoch=?  elapsed=?s  eval_loss=0.2500'"
        bare = "'step=0/1  epoch=?  elapsed=?s'"
        lossy, halfway = "'step=0/1  epoch=?  elapsed=?s  loss=0.5000'", "'step=10.0/20  epoch=?  elapsed=?s'"
    cte(name, ["snapshots"], f"""
SELECT run_id, ts, event_id,
       CASE shape WHEN 0 THEN ('0.'||f)::DOUBLE WHEN 1 THEN step/50.0::DOUBLE WHEN 111 THEN 0.5 ELSE 0.0 END AS fraction,
       CASE shape WHEN 0 THEN 'stage '||st WHEN 1 THEN {steps} WHEN 2 THEN {none} WHEN 103 THEN {bare}
         WHEN 107 THEN {lossy} WHEN 111 THEN {halfway} ELSE '' END AS detail
FROM snapshots""")


progress_cte("progress", "notebook")
progress_cte("host_progress", "host")
cte("history", [], """
SELECT user_id AS run_id, event_id AS step, CASE WHEN event_type <> 'error' THEN value END AS eval_loss FROM events""")
cte("log_lines", [], """
SELECT run_id, unnest(range(len(parts)))::INT AS pos, unnest(parts) AS line FROM (
  SELECT doc_id AS run_id, string_split(text||chr(10)||'Warning: Permanently added host'||chr(10)||
         'Valid: '||(doc_id % 41)||'/40 ('||(doc_id % 41)||'.5%)  [DONE]', chr(10)) AS parts FROM documents)""")
cte("chat_pairs", [], """
SELECT conv_id, turn, text AS prompt, completion FROM (
  SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS completion,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
WHERE role = 'user' AND next_role = 'assistant'""")
