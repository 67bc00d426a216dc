"""SQL expressions over one request: stats struct, ordered object array, tick.

Functions take column names and give expression text. Everything here is a narrow
projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from labelloom.functions import constants as C
from labelloom.functions import rand
from labelloom.functions.text import fixed_sql

OBJECTS_TYPE = "array<struct<id:string,type:string,distance:double>>"


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: list[str]) -> str:
    body = f"array({', '.join(quoted(v) for v in values)})"
    return body if values else f"cast({body} as array<string>)"


def lookup(table: dict[str, list[str]], key: str) -> str:
    """Array for a key from a small literal table; null for an unknown key."""
    entries = ", ".join(f"{quoted(name)}, {string_array(values)}" for name, values in table.items())
    return f"element_at(map({entries}), {key})"


def dominant(stats: str = "stats", order: list[str] = C.LABEL_STATS) -> str:
    """Struct (value, rank, stat) of the highest stat; earlier names win ties."""
    rows = [f"struct({stats}.{name} as value, {-i} as rank, '{name}' as stat)" for i, name in enumerate(order)]
    return f"array_max(array({', '.join(rows)}))"


def nearest(objects: str, types: str) -> str:
    """Id of the nearest object of a wanted type; array order decides ties."""
    wanted = f"filter({objects}, o -> array_contains({types}, o.type))"
    return f"array_min(transform({wanted}, (o, i) -> struct(o.distance as d, i as i, o.id as id))).id"


def idle_or_explore(tick: str = "tick") -> str:
    return f"(case when pmod({tick}, 2) = 0 then 'IDLE' else 'EXPLORE' end)"


def _allowed(types: str, actions: list[str], always: list[str], requires: dict[str, list[str]]) -> dict[str, str]:
    """Condition per action, in declared order."""
    out = {}
    for action in actions:
        if action in always:
            out[action] = "true"
        elif action in requires:
            out[action] = " or ".join(f"array_contains({types}, '{t}')" for t in requires[action])
    return out


def available_actions(
    types: str = "objects.type",
    actions: list[str] = C.ACTIONS,
    always: list[str] = C.ALWAYS_AVAILABLE,
    requires: dict[str, list[str]] = C.ACTION_TYPES,
) -> str:
    """Actions that the types present in the scene allow, in declared order."""
    slots = [f"if({fits}, '{a}', null)" for a, fits in _allowed(types, actions, always, requires).items()]
    return f"array_compact(array({', '.join(slots)}))"


def shuffled_actions(
    row: str,
    seed: int | str = C.DATA_SEED,
    types: str = "objects.type",
    actions: list[str] = C.ACTIONS,
    always: list[str] = C.ALWAYS_AVAILABLE,
    requires: dict[str, list[str]] = C.ACTION_TYPES,
) -> str:
    """The same actions in an order fixed by the digest of (seed, row, action).

    Nulls stand for actions that do not fit; joining the array to text leaves them out.
    """
    slots = []
    for action, fits in _allowed(types, actions, always, requires).items():
        digest = f"md5({rand.key_text(seed, row, quoted(action))})"
        slots.append(f"if({fits}, struct({digest} as k, '{action}' as v), null)")
    return f"sort_array(array({', '.join(slots)})).v"


def stats_text(stats: str = "stats", order: list[str] = C.PROMPT_STATS) -> str:
    rows = [
        f"struct(-{stats}.{name} as neg, {i} as rank, concat('{name}=', {fixed_sql(f'{stats}.{name}', 2)}) as text)"
        for i, name in enumerate(order)
    ]
    ranked = f"sort_array(array({', '.join(rows)})).text"
    return f"concat_ws(', ', concat(({ranked})[0], ' (highest)'), slice({ranked}, 2, {len(order)}))"


def scene_text(objects: str = "objects") -> str:
    part = f"concat(o.type, '(id=', o.id, ',dist=', {fixed_sql('o.distance', 1)}, ')')"
    ranked = f"sort_array(transform({objects}, (o, i) -> struct(o.distance as d, i as i, {part} as text))).text"
    return f"if(size({objects}) = 0, 'empty', array_join({ranked}, ', '))"


def prompt_text(actions: str, stats: str = "stats", objects: str = "objects") -> str:
    """Prompt with stats highest first, objects nearest first and the ``actions`` array as given."""
    lines = [
        quoted(C.PROMPT_INTRO),
        f"concat({quoted(C.PROMPT_STATS_HEAD)}, {stats_text(stats)})",
        quoted(C.PROMPT_RULE),
        quoted(C.PROMPT_GUIDE),
        f"concat({quoted(C.PROMPT_SCENE_HEAD)}, {scene_text(objects)})",
        f"concat({quoted(C.PROMPT_ACTIONS_HEAD)}, array_join({actions}, ', '))",
        quoted(C.PROMPT_TAIL),
    ]
    return f"concat_ws('\\n', {', '.join(lines)})"


def completion_json(label: str = "label") -> str:
    """Answer as JSON text, stat first; absent values are left out."""
    fields = ", ".join(f"{label}.{n} as {n}" for n in ("stat", "action", "target_object_id", "confidence"))
    return f"to_json(struct({fields}), map('ignoreNullFields', 'true'))"


def rule_label(top: str, types: str, target: str, pick: str | None = None, tick: str = "tick") -> str:
    """Struct (stat, action, target_object_id, confidence) by the labelling rule.

    ``top``, ``types`` and ``target`` name columns with the dominant stat, the object
    types it needs and the nearest such object. ``pick`` is a uniform draw that
    chooses between equal actions; the first one is taken without it.
    """
    options = lookup(C.STAT_ACTIONS, f"{top}.stat")
    preferred = f"element_at({options}, 1)" if pick is None else rand.choice(options, pick)
    low = f"{top}.value < {rand.number(C.NEED_THRESHOLD)}"
    act = f"not ({low}) and (size({types}) = 0 or {target} is not null)"
    sure = f"if({low}, 1.0D - {top}.value, {top}.value)"
    return (
        f"struct({top}.stat as stat, if({act}, {preferred}, {idle_or_explore(tick)}) as action, "
        f"if({low}, null, {target}) as target_object_id, "
        f"cast({fixed_sql(sure, 4)} as double) as confidence)"
    )
