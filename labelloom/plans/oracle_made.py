"""Plain SQL twins of the generated requests and probes."""

from __future__ import annotations

from labelloom.functions import constants as C
from labelloom.plans.oracle import TYPES, array, cte, draw, label_ctes, prompt_ctes, rounded

STATS = array(C.LABEL_STATS)
NEEDS = ("CASE {0} WHEN 'hunger' THEN ['bowl'] WHEN 'tiredness' THEN ['bed'] WHEN 'boredom' THEN ['toy'] "
         "WHEN 'social' THEN ['player','pet'] WHEN 'toilet' THEN []::VARCHAR[] END")


def between(low: float, high: float, u: str) -> str:
    """The same double arithmetic: low + u * (high - low)."""
    return f"(CAST('{low!r}' AS DOUBLE) + {u} * CAST('{high - low!r}' AS DOUBLE))"


def made_ctes(prefix: str, seed: object, where: str = "true") -> None:
    """Requests drawn for each order id, with labels, prompts and completions."""
    u = lambda tag: draw(seed, "o_orderkey", f"'{tag}'")
    per_index = lambda tag: draw(seed, "request_id", f"'{tag}-'||i")
    cte(f"{prefix}ids", [], f"""
SELECT *, CASE WHEN {u('clash')} < 0.15 THEN list_filter({STATS}, lambda x: x <> dominant)[floor({u('second')}*4)::INT+1] END AS second
FROM (SELECT o_orderkey, {STATS}[((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)+1] AS dominant FROM orders WHERE {where})""")
    stat = []
    for s in C.LABEL_STATS:
        v = u(f"stat-{s}")
        stat.append(
            f"CASE WHEN dominant = '{s}' AND second IS NOT NULL THEN {between(0.8, 1.0, v)} WHEN dominant = '{s}' THEN {between(0.7, 1.0, v)} "
            f"WHEN second = '{s}' THEN {between(0.6, 0.79, v)} ELSE {between(0.0, 0.35, v)} END AS {s}")
    cte(f"{prefix}requests", [f"{prefix}ids"], f"""
SELECT o_orderkey AS request_id, dominant, second, floor({u('tick')}*10001)::BIGINT AS tick, {", ".join(stat)} FROM {prefix}ids""")
    cte(f"{prefix}plan", [f"{prefix}ids"], f"""
SELECT o_orderkey AS request_id, needed, present, CASE WHEN present AND len(needed) > 0 THEN 2 + floor({u('rivals')}*3)::INT ELSE 0 END AS rivals,
       floor({u('extras')}*4)::INT AS extras, floor({u('others')}*6)::INT AS others,
       CASE WHEN present THEN {TYPES} ELSE list_filter({TYPES}, lambda x: NOT list_contains(needed, x)) END AS pool,
       needed[floor({u('rival')}*len(needed))::INT+1] AS rival
FROM (SELECT *, len(needed) = 0 OR {u('present')} < 0.75 AS present FROM (SELECT *, {NEEDS.format('dominant')} AS needed FROM {prefix}ids))""")
    cte(f"{prefix}objects", [f"{prefix}plan"], f"""
SELECT request_id, present, id, type, distance,
       CASE WHEN present THEN row_number() OVER (PARTITION BY request_id ORDER BY md5('{seed}:'||request_id||':mix-'||id), id) - 1 ELSE i END AS pos
FROM (SELECT request_id, present, i, 'obj_'||i AS id,
             CASE WHEN i < rivals THEN rival ELSE pool[floor({per_index('type')}*len(pool))::INT+1] END AS type,
             {rounded(between(1.0, 50.0, per_index('dist')), 1)} AS distance
      FROM {prefix}plan, unnest(range(CASE WHEN present THEN rivals + extras ELSE others END)) r(i))""")
    label_ctes(prefix, f"{prefix}requests", f"{prefix}objects", str(seed))
    prompt_ctes(prefix, f"{prefix}requests", f"{prefix}objects", seed)


SCORED = """
SELECT p.request_id, CASE WHEN length(prompt) % 13 = 0 THEN NULL WHEN length(prompt) % 11 = 0 THEN 'no idea'
   WHEN p.highest <> 'toilet' AND n.id IS NULL THEN '{{"stat":"'||p.highest||'","action":"IDLE"}}'
   ELSE 'Answer: {{"stat":"'||p.highest||'","action":"'||a.action||'"'||
        CASE WHEN n.id IS NULL THEN '' ELSE ',"target_object_id":"'||n.id||'"' END||'}}' END AS raw,
   CASE WHEN length(prompt) % 13 = 0 OR length(prompt) % 11 = 0 OR (p.highest <> 'toilet' AND n.id IS NULL) THEN 'IDLE' ELSE a.action END AS action,
   CASE WHEN length(prompt) % 13 <> 0 AND length(prompt) % 11 <> 0 THEN n.id END AS target
FROM {0}prompts p JOIN stat_actions a ON a.stat = p.highest AND a.idx = 0
LEFT JOIN (SELECT request_id, stat, id FROM (
   SELECT o.request_id, s.stat, o.id, row_number() OVER (PARTITION BY o.request_id, s.stat ORDER BY o.distance, o.pos) AS rn
   FROM {1} o JOIN stat_types s ON s.type = o.type) WHERE rn = 1) n ON n.request_id = p.request_id AND n.stat = p.highest"""
cte("scored", ["prompts", "objects", "stat_actions", "stat_types"], SCORED.format("", "objects"))

made_ctes("gen_", C.DATA_SEED)
made_ctes("train_", f"{C.DATA_SEED}-train", "o_orderkey % 11 <> 10")
made_ctes("eval_", f"{C.DATA_SEED}-eval", "o_orderkey % 11 = 10")

# -- probes ------------------------------------------------------------------

_S = C.PROBE_SEED
_NEEDY = array([s for s in C.LABEL_STATS if C.STAT_TYPES[s]])


def _u(tag: str) -> str:
    return draw(_S, "request_id", f"'{tag}'")


cte("probe_ids", [], f"""
SELECT *, CASE WHEN kind = 'conflict' THEN list_filter({STATS}, lambda x: x <> stat)[floor({_u('second')}*4)::INT+1] END AS second,
       {NEEDS.format('stat')} AS needed
FROM (SELECT request_id, kind, CASE kind WHEN 'stat' THEN {STATS}[(turn % 5)+1] WHEN 'conflict' THEN {STATS}[floor({_u('main')}*5)::INT+1]
             WHEN 'absent' THEN {_NEEDY}[floor({_u('main')}*4)::INT+1] END AS stat
      FROM (SELECT o_orderkey AS request_id, o_orderkey % 22 AS turn,
                   CASE WHEN o_orderkey % 22 < 10 THEN 'stat' WHEN o_orderkey % 22 = 10 THEN 'conflict'
                        WHEN o_orderkey % 22 = 11 THEN 'absent' ELSE 'random' END AS kind FROM orders))""")
_values = []
for _name in C.LABEL_STATS:
    _v = _u(f"stat-{_name}")
    _values.append(
        f"CASE WHEN kind = 'random' THEN {rounded(_v, 2)} WHEN stat = '{_name}' AND kind = 'conflict' THEN {rounded(between(0.85, 1.0, _v), 2)} "
        f"WHEN stat = '{_name}' THEN 0.9 WHEN second = '{_name}' THEN {rounded(between(0.60, 0.79, _v), 2)} ELSE 0.1 END::DOUBLE AS {_name}")
cte("probe_requests", ["probe_ids"], f"""
SELECT request_id, kind, stat, second, floor({_u('tick')}*10001)::BIGINT AS tick, {", ".join(_values)} FROM probe_ids""")


def _fixed(name: str, kind: str, low: float, high: float, tag: str) -> str:
    return (f"SELECT request_id, {name} AS id, {kind} AS type, {rounded(between(low, high, _u(tag)), 1)} AS distance, "
            f"md5('{_S}:'||request_id||':mix-'||{name}) AS k FROM probe_ids")


_others = f"list_filter({TYPES}, lambda x: NOT list_contains(needed, x))"
_for_stat = " UNION ALL ".join(
    _fixed(f"'{n}'", t, lo, hi, tag) + " WHERE kind = 'stat' AND len(needed) > 0"
    for n, t, lo, hi, tag in [
        ("target_0", "needed[1]", 1.0, 4.0, "near"),
        ("target_1", "needed[1]", 8.0, 15.0, "middle"),
        ("target_2", "needed[1]", 20.0, 40.0, "far"),
        ("distractor_0", f"({_others})[1]", 1.0, 3.0, "other"),
    ])
_for_conflict = " UNION ALL ".join(
    f"SELECT request_id, {c}||'_obj' AS id, ({NEEDS.format(c)})[1] AS type, {rounded(between(2.0, 10.0, _u(tag)), 1)} AS distance, '{i}' AS k "
    f"FROM probe_ids WHERE kind = 'conflict' AND {c} <> 'toilet'"
    for i, (c, tag) in enumerate([("stat", "dist-main"), ("second", "dist-second")]))


def _scattered(kind: str, pool: str, n: str, high: float) -> str:
    at = lambda tag: draw(_S, "request_id", f"'{tag}-'||i")
    return (f"SELECT request_id, 'obj_'||i AS id, ({pool})[floor({at('type')}*len({pool}))::INT+1] AS type, "
            f"{rounded(between(1.0, high, at('dist')), 1)} AS distance, i::VARCHAR AS k "
            f"FROM probe_ids, unnest(range({n})) r(i) WHERE kind = '{kind}'")


cte("probe_objects", ["probe_ids"], f"""
SELECT request_id, id, type, distance, row_number() OVER (PARTITION BY request_id ORDER BY k, id) - 1 AS pos FROM (
{_for_stat} UNION ALL {_for_conflict}
UNION ALL {_scattered('absent', _others, f"1 + floor({_u('n')}*4)::INT", 20.0)}
UNION ALL {_scattered('random', TYPES, f"floor({_u('n')}*7)::INT", 50.0)})""")
label_ctes("probe_", "probe_requests", "probe_objects")
prompt_ctes("probe_", "probe_requests", "probe_objects", _S)
cte("probe_scored", ["probe_prompts", "probe_objects", "stat_actions", "stat_types"], SCORED.format("probe_", "probe_objects"))
cte("probe_judged", ["probe_scored", "probe_ids", "stat_actions"], """
SELECT *, action_ok AND target_expected AND target IS NOT NULL AS target_counts,
       action_ok AND target_expected AND coalesce(target = 'target_0', false) AS target_ok
FROM (SELECT p.request_id, p.kind, p.stat, s.action, s.target, p.kind = 'stat' AND len(p.needed) > 0 AS target_expected,
             CASE p.kind WHEN 'absent' THEN s.action IN ('IDLE','EXPLORE') WHEN 'random' THEN false
                  ELSE EXISTS (SELECT 1 FROM stat_actions a WHERE a.stat = p.stat AND a.action = s.action) END AS action_ok
      FROM probe_ids p JOIN probe_scored s USING (request_id))""")
