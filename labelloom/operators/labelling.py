"""Rule labelling of requests, nested or flat, and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions import rand, scenes
from labelloom.operators.lookup import join_lookup


def with_dominant(df: DataFrame, stats: str = "stats", into: str = "top") -> DataFrame:
    return df.withColumn(into, F.expr(scenes.dominant(stats)))


def label_requests(df: DataFrame, seed: int | str | None = None, key: str = "request_id") -> DataFrame:
    """Add the ``label`` struct to requests with stats, objects and tick columns."""
    pick = None if seed is None else rand.unit(seed, key, "'action'")
    staged = (
        with_dominant(df, into="_top")
        .withColumn("_types", F.expr(scenes.lookup(C.STAT_TYPES, "_top.stat")))
        .withColumn("_target", F.expr(scenes.nearest("objects", "_types")))
    )
    label = scenes.rule_label("_top", "_types", "_target", pick)
    return staged.withColumn("label", F.expr(label)).drop("_top", "_types", "_target")


def with_prompt(df: DataFrame, seed: int | str = C.DATA_SEED, key: str = "request_id", into: str = "prompt") -> DataFrame:
    """Add the prompt text; the shuffle of its actions is fixed by seed and key."""
    staged = df.withColumn("_types", F.expr("array_distinct(objects.type)")).withColumn(
        "_actions", F.expr(scenes.shuffled_actions(key, seed, "_types"))
    )
    return staged.withColumn(into, F.expr(scenes.prompt_text("_actions"))).drop("_types", "_actions")


def render_examples(df: DataFrame, seed: int | str = C.DATA_SEED, key: str = "request_id") -> DataFrame:
    """Add prompt and completion texts to labelled requests."""
    return with_prompt(df, seed, key).withColumn("completion", F.expr(scenes.completion_json()))


def unpivot_stats(df: DataFrame, key: str = "request_id", stats: str = "stats") -> DataFrame:
    wide = df.select(key, *[F.col(f"{stats}.{s}").alias(s) for s in C.LABEL_STATS])
    return wide.unpivot(key, C.LABEL_STATS, "stat", "value")


def nearest_by_type(
    objects: DataFrame,
    order: list[str],
    key: str = "request_id",
    kind: str = "type",
    distance: str = "distance",
    object_id: str = "id",
) -> DataFrame:
    """Nearest object per request and type from a flat object table.

    Objects of a request are reduced on the map side, so a request with very many
    objects never gathers in one task. ``order`` columns decide equal distances.
    """
    place = F.struct(F.col(distance).alias("distance"), *[F.col(c) for c in order])
    return objects.groupBy(key, kind).agg(
        F.min_by(object_id, place).alias("nearest_id"),
        F.min(place).alias("place"),
        F.count("*").alias("objects"),
    )


def nearest_by_stat(
    objects: DataFrame,
    order: list[str],
    key: str = "request_id",
    kind: str = "type",
    distance: str = "distance",
    object_id: str = "id",
) -> DataFrame:
    """One row per request: the nearest object for each stat that needs one.

    A single map-side reduced aggregate on the request key.
    """
    place = f"struct({', '.join([distance, *order])})"
    aggs = []
    for stat, types in C.STAT_TYPES.items():
        if types:
            fits = f"array_contains({scenes.string_array(types)}, {kind})"
            aggs.append(
                F.expr(f"min_by({object_id}, if({fits}, {place}, null))").alias(f"near_{stat}")
            )
    return objects.groupBy(key).agg(*aggs)


def label_flat(requests: DataFrame, nearest: DataFrame, key: str = "request_id") -> DataFrame:
    """Rule labels for requests whose objects live in their own table.

    ``nearest`` comes from ``nearest_by_stat``; its grouping serves the join too.
    """
    top = with_dominant(requests, into="_top").select(
        key, "tick", "_top", F.expr(scenes.lookup(C.STAT_TYPES, "_top.stat")).alias("_types")
    )
    cases = " ".join(f"when '{s}' then near_{s}" for s, types in C.STAT_TYPES.items() if types)
    joined = top.join(nearest, key, "left").withColumn("_target", F.expr(f"case _top.stat {cases} end"))
    label = F.expr(scenes.rule_label("_top", "_types", "_target"))
    return joined.select(key, label.alias("label")).select(key, "label.*")


def rule_lookup(labelled: DataFrame, rules: DataFrame, on: str = "stat") -> DataFrame:
    """Join labelled rows to a user-supplied rule table with one row per ``on`` value."""
    return join_lookup(labelled, rules, on, "left")


def request_violations(stats: str = "stats", objects: str = "objects", tick: str = "tick") -> str:
    """Names of the rules that a request breaks; an empty array means valid."""
    checks = []
    for name in C.PROMPT_STATS:
        v = f"{stats}.{name}"
        inside = f"coalesce({v} >= 0.0D and {v} <= 1.0D and not isnan({v}), false)"
        checks.append(f"if({inside}, null, 'range:{name}')")
    checks.append(f"if({tick} is null, 'required:tick', null)")
    checks.append(f"if({objects} is null, 'required:objects', null)")
    known = f"coalesce(array_contains({scenes.string_array(C.OBJECT_TYPES)}, o.type), false)"
    odd = f"exists({objects}, o -> o.id is null or o.distance is null or not {known})"
    checks.append(f"if({odd}, 'enum:object', null)")
    return f"array_compact(array({', '.join(checks)}))"


def _scored(section: str) -> str:
    return (
        f"coalesce({section}.correct is not null and {section}.total is not null and {section}.passed is not null "
        f"and {section}.accuracy >= 0.0D and {section}.accuracy <= 1.0D, false)"
    )


def report_violations(report: str = "report") -> str:
    """Names of the rules that a parsed quality report breaks."""
    stats = f"{report}.per_stat_accuracy"
    required = scenes.string_array(sorted(C.STAT_TYPES))
    missing = f"array_except({required}, map_keys({stats}))"
    checks = [
        f"if({stats} is null, 'required:per_stat_accuracy', null)",
        f"if(size({missing}) > 0, concat('missing:', array_join({missing}, ',')), null)",
        f"if(exists(map_values({stats}), r -> not {_scored('r')}), 'range:per_stat_accuracy', null)",
    ]
    for name in ("target_accuracy", "priority_conflict", "fallback_accuracy"):
        checks.append(f"if({_scored(f'{report}.{name}')}, null, 'range:{name}')")
    for name in ("action_distribution", "max_action_share", "passed"):
        checks.append(f"if({report}.{name} is null, 'required:{name}', null)")
    return f"array_compact(array({', '.join(checks)}))"
