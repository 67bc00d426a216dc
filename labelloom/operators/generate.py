"""Synthetic requests and probes as projections over a table of row ids.

Each value is a draw fixed by (seed, id, tag), so rows can be made anywhere, in any
order and again after a lost task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions import rand, scenes
from labelloom.functions.text import rounded_sql
from labelloom.operators.labelling import label_requests, render_examples
from labelloom.operators.numbering import numbered
from labelloom.operators.quality import balance_of, with_class, with_validity
from labelloom.sources.jsonl import mark_lines, read_lines, write_examples

KEY = "request_id"
MIX_TAG = "concat('mix-', o.id)"
ORDER_TAG = "'order'"


def _distance(low: float, high: float, u: str) -> str:
    return rounded_sql(rand.between(low, high, u), 1)


def _first_places(n: str, most: int) -> str:
    """Array 0 .. n-1; sequence() would count down for n = 0."""
    return f"slice(array({', '.join(str(i) for i in range(most))}), 1, {n})"


def stratify(ids: DataFrame, key: str = KEY) -> DataFrame:
    """Add the dominant stat in turn; ids without holes give equal counts."""
    names = scenes.string_array(C.LABEL_STATS)
    return ids.withColumn("dominant", F.expr(f"element_at({names}, cast(pmod({key}, 5) as int) + 1)"))


def stratify_exactly(ids: DataFrame, key: str = KEY) -> DataFrame:
    """Add the dominant stat by the id's place among all ids: n/5 rows per stat, the rest to the first stats.

    Ids may have holes; a repeated id takes a place for each of its rows.
    """
    names = scenes.string_array(C.LABEL_STATS)
    placed = numbered(ids, key, name="_place")
    return placed.withColumn("dominant", F.expr(f"element_at({names}, cast(_place % 5 as int) + 1)")).drop("_place")


def add_stats(df: DataFrame, seed: int | str = C.DATA_SEED, key: str = KEY) -> DataFrame:
    """Stats with one high value; some rows get a second, lower high value."""
    u = lambda tag: rand.unit(seed, key, f"'{tag}'")
    others = f"array_remove({scenes.string_array(C.LABEL_STATS)}, dominant)"
    clash = f"{u('clash')} < {rand.number(C.CONFLICT_RATE)}"
    second = f"if({clash}, {rand.choice(others, u('second'))}, null)"

    def value(stat: str) -> str:
        draw = u(f"stat-{stat}")
        return (
            f"case when dominant = '{stat}' and second is not null then {rand.between(0.80, 1.0, draw)} "
            f"when dominant = '{stat}' then {rand.between(0.70, 1.0, draw)} "
            f"when second = '{stat}' then {rand.between(0.60, 0.79, draw)} "
            f"else {rand.between(0.0, 0.35, draw)} end"
        )

    stats = ", ".join(f"{value(s)} as {s}" for s in C.PROMPT_STATS)
    return df.withColumn("second", F.expr(second)).withColumn("stats", F.expr(f"struct({stats})"))


def _object(seed: int | str, key: str, kind: str, low: float, high: float) -> str:
    """Object number i as a struct; its distance is a draw of its own."""
    distance = _distance(low, high, rand.unit(seed, key, "concat('dist-', i)"))
    return f"struct(concat('obj_', i) as id, {kind} as type, {distance} as distance)"


def mixed(objects: str, seed: int | str, key: str) -> str:
    """Objects in an order fixed by the digest of their ids."""
    digest = f"md5({rand.key_text(seed, key, MIX_TAG)})"
    return f"sort_array(transform({objects}, o -> struct({digest} as k, o as o))).o"


def add_scene(df: DataFrame, seed: int | str = C.DATA_SEED, key: str = KEY) -> DataFrame:
    """Objects and tick: mostly several rivals of one fitting type, else no fitting object."""
    u = lambda tag: rand.unit(seed, key, f"'{tag}'")
    all_types = scenes.string_array(C.OBJECT_TYPES)
    free = "size(_needed) = 0"
    pick = rand.choice("_pool", rand.unit(seed, key, "concat('type-', i)"))
    kind = f"if(i < _rivals, _rival, {pick})"
    made = f"transform({_first_places('_n', 7)}, i -> {_object(seed, key, kind, 1.0, 50.0)})"
    steps = [
        ("_needed", scenes.lookup(C.STAT_TYPES, "dominant")),
        ("present", f"{free} or {u('present')} < {rand.number(C.OBJECT_PRESENT_RATE)}"),
        ("_rivals", f"if(present and not ({free}), {rand.integer(2, 4, u('rivals'))}, 0)"),
        ("_n", f"if(present, _rivals + {rand.integer(0, 3, u('extras'))}, {rand.integer(0, 5, u('others'))})"),
        ("_pool", f"if(present, {all_types}, array_except({all_types}, _needed))"),
        ("_rival", f"if({free}, null, {rand.choice('_needed', u('rival'))})"),
        ("_made", made),
        ("objects", f"if(present, {mixed('_made', seed, key)}, _made)"),
        ("tick", f"cast({rand.integer(0, C.MAX_TICK, u('tick'))} as bigint)"),
    ]
    out = df
    for name, text in steps:
        out = out.withColumn(name, F.expr(text))
    return out.drop("_needed", "_rivals", "_n", "_pool", "_rival", "_made")


def make_requests(ids: DataFrame, seed: int | str = C.DATA_SEED, key: str = KEY) -> DataFrame:
    """Requests of row ids; a ``dominant`` stat that comes with the ids is taken."""
    asked = ids if "dominant" in ids.columns else stratify(ids, key)
    return add_scene(add_stats(asked, seed, key), seed, key)


def make_examples(ids: DataFrame, seed: int | str = C.DATA_SEED, key: str = KEY) -> DataFrame:
    """Labelled examples; the stat in the completion is the dominant one asked for."""
    out = label_requests(make_requests(ids, seed, key), seed, key)
    named = out.withColumn("label", F.col("label").withField("stat", F.col("dominant")))
    return render_examples(named, seed, key)


def in_mixed_order(ids: DataFrame, seed: int | str = C.DATA_SEED, key: str = KEY, tasks: int | None = None) -> DataFrame:
    """Row ids spread over tasks and ordered in each by a digest of the id.

    Only ids move; the wide texts are made afterwards, in place. ``tasks`` sets the
    number of output files and defaults to the session's shuffle partitions: with an
    explicit number, small ids are not merged into few tasks that then do all the work.
    """
    count = tasks or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.expr(f"md5({rand.key_text(seed, key, ORDER_TAG)})")
    return ids.repartition(count, key).sortWithinPartitions(digest)


def generate_dataset(
    splits: dict[str, DataFrame], out_dir: str, seed: int = C.DATA_SEED, key: str = KEY, tasks: int | None = None
) -> DataFrame:
    """Make, write, read back and judge each split; one verdict row per split.

    ``splits`` maps a name to a table of row ids. Each split salts the draws, and is
    written as JSONL under ``out_dir/<name>``. Stats are dealt by the places of the ids, so
    each drives n/5 examples, the rest the first ones, whatever holes the ids have. What was written is what is checked.
    """
    verdicts: DataFrame | None = None
    for name, ids in splits.items():
        salt = f"{seed}-{name}"
        target = f"{out_dir.rstrip('/')}/{name}"
        asked = in_mixed_order(stratify_exactly(ids.select(key), key), salt, key, tasks)
        write_examples(make_examples(asked, salt, key), target)
        row = judge_examples(ids.sparkSession, target).select(F.lit(name).alias("split"), "*")
        verdicts = row if verdicts is None else verdicts.unionByName(row)
    if verdicts is None:
        raise ValueError("no splits given")
    return verdicts


def judge_examples(spark: SparkSession, path: str) -> DataFrame:
    """One row: line counts, balance counts and the verdict over written JSONL.

    The files are read and parsed once; both judgements come from one small table of
    counts per class.
    """
    rows = with_validity(with_class(mark_lines(read_lines(spark, path))))
    counts = rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if("valid").alias("ok"))
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    judged = balance_of(counts).agg(
        sum_of("n").alias("total"),
        sum_of("ok").alias("valid"),
        F.count("class").alias("classes"),
        F.count_if(F.col("flag") == "UNDER").alias("under"),
        F.count_if(F.col("flag") == "OVER").alias("over"),
    )
    invalid = F.col("total") - F.col("valid")
    even = F.col("under") + F.col("over") == 0
    return judged.select(
        "total", "valid", invalid.alias("invalid"), "classes", "under", "over", ((invalid == 0) & even).alias("passed")
    )


# -- probes ------------------------------------------------------------------

# Shares of the probe kinds: 200 stat, 20 conflict, 20 absent, 200 random.
PROBE_CYCLE = 22


def make_probes(ids: DataFrame, seed: int | str = C.PROBE_SEED, key: str = KEY) -> DataFrame:
    """Probe requests of four kinds with the expected actions and target.

    Kinds rotate with the id in the fixed proportions; stat probes cover all stats.
    """
    u = lambda tag: rand.unit(seed, key, f"'{tag}'")
    turn = f"pmod({key}, {PROBE_CYCLE})"
    names = scenes.string_array(C.LABEL_STATS)
    needy = scenes.string_array([s for s in C.LABEL_STATS if C.STAT_TYPES[s]])
    all_types = scenes.string_array(C.OBJECT_TYPES)

    def value(stat: str) -> str:
        draw = u(f"stat-{stat}")
        return (
            f"case when kind = 'random' then {rounded_sql(draw, 2)} "
            f"when stat = '{stat}' and kind = 'conflict' then {rounded_sql(rand.between(0.85, 1.0, draw), 2)} "
            f"when stat = '{stat}' then 0.9D "
            f"when second = '{stat}' then {rounded_sql(rand.between(0.60, 0.79, draw), 2)} else 0.1D end"
        )

    def named(name: str, kind: str, low: float, high: float, tag: str) -> str:
        return f"struct({name} as id, {kind} as type, {_distance(low, high, u(tag))} as distance)"

    none = f"cast(array() as {scenes.OBJECTS_TYPE})"
    targets = ", ".join(
        [
            named("'target_0'", "_needed[0]", 1.0, 4.0, "near"),
            named("'target_1'", "_needed[0]", 8.0, 15.0, "middle"),
            named("'target_2'", "_needed[0]", 20.0, 40.0, "far"),
            named("'distractor_0'", "_others[0]", 1.0, 3.0, "other"),
        ]
    )
    for_stat = f"if(size(_needed) = 0, {none}, {mixed(f'array({targets})', seed, key)})"

    def of_stat(stat: str, types: str, tag: str) -> str:
        there = named(f"concat({stat}, '_obj')", f"{types}[0]", 2.0, 10.0, tag)
        return f"if(size({types}) = 0, {none}, array({there}))"

    for_conflict = (
        f"concat({of_stat('stat', '_needed', 'dist-main')}, {of_stat('second', '_needed2', 'dist-second')})"
    )

    def scattered(pool: str, n: str, high: float) -> str:
        pick = rand.choice(pool, rand.unit(seed, key, "concat('type-', i)"))
        return f"transform({_first_places(n, 6)}, i -> {_object(seed, key, pick, 1.0, high)})"

    stats = ", ".join(f"{value(s)} as {s}" for s in C.PROMPT_STATS)
    steps = [
        ("kind", f"case when {turn} < 10 then 'stat' when {turn} = 10 then 'conflict' when {turn} = 11 then 'absent' else 'random' end"),
        ("stat", f"case kind when 'stat' then element_at({names}, cast({turn} % 5 as int) + 1) "
                 f"when 'conflict' then {rand.choice(names, u('main'))} when 'absent' then {rand.choice(needy, u('main'))} end"),
        ("second", f"if(kind = 'conflict', {rand.choice(f'array_remove({names}, stat)', u('second'))}, null)"),
        ("_needed", scenes.lookup(C.STAT_TYPES, "stat")),
        ("_needed2", scenes.lookup(C.STAT_TYPES, "second")),
        ("_others", f"array_except({all_types}, _needed)"),
        ("stats", f"struct({stats})"),
        ("objects", f"case kind when 'stat' then {for_stat} when 'conflict' then {for_conflict} "
                    f"when 'absent' then {scattered('_others', rand.integer(1, 4, u('n')), 20.0)} "
                    f"else {scattered(all_types, rand.integer(0, 6, u('n')), 50.0)} end"),
        ("tick", f"cast({rand.integer(0, C.MAX_TICK, u('tick'))} as bigint)"),
        ("expected_actions", f"case kind when 'absent' then {scenes.string_array(C.FALLBACK_ACTIONS)} "
                             f"when 'random' then null else {scenes.lookup(C.STAT_ACTIONS, 'stat')} end"),
        ("expected_target", "if(kind = 'stat' and size(_needed) > 0, 'target_0', null)"),
    ]
    out = ids
    for name, text in steps:
        out = out.withColumn(name, F.expr(text))
    return out.drop("_needed", "_needed2", "_others")
