"""Counts, shares, gates and accuracy over examples and answers.

Classes are few and may each hold a large part of the rows, so everything is a
map-side reduced aggregate; nothing gathers the rows of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.jsontext import ends_after_value, parse_objects, text_field
from labelloom.functions.responses import check_answers, is_ok
from labelloom.functions.text import fixed, rounded
from labelloom.operators.lookup import join_lookup
from labelloom.sources.session import settled


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# -- classes -----------------------------------------------------------------


def with_class(df: DataFrame, completion: str = "completion", into: str = "class", strict: bool = True) -> DataFrame:
    """Add the action text of a completion.

    Strict: null where the text is no JSON object with a text action, so that the row
    leaves the total. Otherwise an absent action or bad text counts as the idle class.
    """
    parsed = parse_objects(df, F.col(completion), ["action"], "_c")
    found = F.when(F.col("_c_object"), text_field("_c_fields", "action"))
    value = found if strict else F.coalesce(found, F.lit(C.DEFAULT_ACTION))
    return parsed.withColumn(into, value).drop("_c_json", "_c_object", "_c_fields")


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per class; rows without a class are left out after counting."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count(column).alias("n"))
    return counts.filter(F.col("n") > 0)


def class_balance(
    df: DataFrame,
    column: str,
    low: float = C.MIN_CLASS_SHARE,
    high: float = C.MAX_CLASS_SHARE,
    min_rows: int = C.MIN_BALANCE_ROWS,
    expected_classes: list[str] | None = None,
) -> DataFrame:
    """Columns class, n, total, share, flag (UNDER, OVER or empty).

    Flags are left out below ``min_rows``. Only seen classes are listed, unless
    ``expected_classes`` adds the missing ones with zero rows.
    """
    counts = class_counts(df, column)
    if expected_classes is not None:
        names = df.sparkSession.createDataFrame([(c,) for c in expected_classes], "class string")
        counts = names.join(counts, "class", "full").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    return balance_of(counts, low, high, min_rows)


def balance_of(
    counts: DataFrame,
    low: float = C.MIN_CLASS_SHARE,
    high: float = C.MAX_CLASS_SHARE,
    min_rows: int = C.MIN_BALANCE_ROWS,
) -> DataFrame:
    """The same from a small table of class and n, which is stored first; a row without a class has no share in the total."""
    kept = settled(counts)
    total = kept.filter(F.col("class").isNotNull()).agg(F.sum("n").alias("t")).first()["t"] or 0
    share = F.col("share")
    flag = (
        F.when((F.col("total") < min_rows) | F.col("class").isNull(), "")
        .when(share < low, "UNDER")
        .when(share > high, "OVER")
        .otherwise("")
    )
    return (
        kept.withColumn("total", F.lit(total).cast("bigint"))
        .withColumn("share", ratio(F.col("n"), F.col("total")))
        .withColumn("flag", flag)
    )


def balance_violations(balance: DataFrame, low: float = C.MIN_CLASS_SHARE, high: float = C.MAX_CLASS_SHARE) -> DataFrame:
    """One message per class outside the band."""
    pct = F.concat(fixed(F.col("share") * 100, 1), F.lit("%"))
    under = F.concat(F.col("class"), F.lit(" underrepresented ("), pct, F.lit(f" < {low:.0%})"))
    over = F.concat(F.col("class"), F.lit(" overrepresented ("), pct, F.lit(f" > {high:.0%})"))
    return balance.filter(F.col("flag") != "").select(
        "class", "flag", F.when(F.col("flag") == "UNDER", under).otherwise(over).alias("message")
    )


def balance_gate(balance: DataFrame) -> DataFrame:
    """One row: classes, rows, classes under and over, passed."""
    return balance.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("flag") == "UNDER").alias("under"),
        F.count_if(F.col("flag") == "OVER").alias("over"),
    ).withColumn("passed", (F.col("under") + F.col("over")) == 0)


def require_balance(balance: DataFrame) -> None:
    """Raise ValueError unless every class is inside the band; the text lists every violation, one per class."""
    gate = balance_gate(balance).first()
    if not gate["passed"]:
        messages = balance_violations(balance).orderBy("class").collect()
        head = f"{gate['under'] + gate['over']} of {gate['classes']} classes out of bounds:"
        raise ValueError("\n  ".join([head, *[m["message"] for m in messages]]))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """Add ``weight`` = n / (classes * rows of the class) to every row; a row without a class stops the job."""
    counts = settled(class_counts(df, column))
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    rows, classes = sums["n"] or 0, sums["k"]
    weights = counts.select(
        F.col("class").alias(column),
        (F.lit(float(rows)) / (F.lit(float(classes)) * F.col("n"))).alias("weight"),
    )
    no_class = F.raise_error(F.lit(f"row without {column}")).cast("double")
    return join_lookup(df, weights, column, "left", stored=True).withColumn("weight", F.coalesce("weight", no_class))


# -- validity ----------------------------------------------------------------


def with_validity(marked: DataFrame) -> DataFrame:
    """Add ``valid`` to rows from ``mark_lines``: a legal completion and a full prompt."""
    checked = check_answers(marked, F.col("completion"))
    staged = checked.withColumn("_end", ends_after_value(F.col("completion")))
    full = F.coalesce(F.contains("prompt", F.lit(C.PROMPT_MARKER)), F.lit(False))
    return staged.withColumn("valid", F.col("_a_valid") & F.col("_end") & full).select(*marked.columns, "valid")


def validity_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )


def first_errors(checked: DataFrame, order: str, k: int = 10) -> DataFrame:
    """The first k invalid rows with the number of further ones on each row.

    One pass checks each row once: while tasks keep their first rows, Spark counts the
    invalid ones on the way. Sorting invalid rows first keeps the costly check out of a
    filter, where it would be computed a second time.
    """
    seen = Observation()
    counted = checked.observe(seen, F.count_if(~F.col("valid")).alias("bad"))
    first = settled(counted.orderBy("valid", order).limit(k))
    more = max(seen.get["bad"] - k, 0)
    return first.filter(~F.col("valid")).withColumn("more", F.lit(more).cast("bigint"))


# -- answers -----------------------------------------------------------------


def valid_rate(
    statuses: DataFrame, status: str = "status", threshold: float = C.VALID_RATE_PASS, held: Column | None = None
) -> DataFrame:
    """One row: total, valid, valid_pct, passed (inclusive; no rows fail). ``held`` counts rows of each input row."""
    n = F.lit(1).cast("bigint") if held is None else held
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    counts = statuses.agg(
        sum_of(n).alias("total"), sum_of(F.when(is_ok(F.col(status)), n).otherwise(0)).alias("valid")
    )
    pct = ratio(F.col("valid"), F.col("total"))
    return counts.withColumn("valid_pct", pct).withColumn(
        "passed", (F.col("total") > 0) & (pct >= threshold)
    )


def share_table(df: DataFrame, column: str, limit: float = C.MAX_ACTION_SHARE) -> DataFrame:
    """Histogram with share in percent and a DOMINANT flag."""
    counts = settled(class_counts(df, column))
    total = counts.agg(F.sum("n").alias("t")).first()["t"]
    share = ratio(F.col("n"), F.lit(total))
    return counts.select(
        F.col("class").alias(column),
        F.col("n").alias("count"),
        fixed(share * 100, 1).alias("pct"),
        F.when(share > limit, "DOMINANT").otherwise("").alias("flag"),
    ).orderBy(F.desc("count"), column)


def action_accuracy(predicted: DataFrame, expected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Totals and per-class counts of predictions against expected actions.

    Both sides carry ``key``; a missing or unparsable prediction counts as ``[INVALID]``.
    """
    pairs = expected.join(predicted, key, "left").select(
        "expected", F.coalesce("predicted", F.lit("[INVALID]")).alias("predicted")
    )
    per_class = pairs.groupBy("predicted").agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("expected")).alias("correct")
    )
    totals = per_class.agg(F.sum("n").alias("total"), F.sum("correct").alias("correct"))
    return totals.withColumn("accuracy", ratio(F.col("correct"), F.col("total"))), per_class


# -- probe report ------------------------------------------------------------


def judged(probes: DataFrame) -> DataFrame:
    """Per probe: action_ok, target_counts, target_ok. Needs an ``answer`` struct."""
    action_ok = F.coalesce(F.array_contains("expected_actions", F.col("answer.action")), F.lit(False))
    counts = (
        (F.col("kind") == "stat")
        & action_ok
        & F.col("expected_target").isNotNull()
        & F.col("answer.target_object_id").isNotNull()
    )
    return probes.select(
        "kind",
        "stat",
        F.col("answer.action").alias("action"),
        action_ok.alias("action_ok"),
        counts.alias("target_counts"),
        (counts & (F.col("answer.target_object_id") == F.col("expected_target"))).alias("target_ok"),
    )


def per_stat_accuracy(rows: DataFrame, threshold: float = C.STAT_ACCURACY_PASS) -> DataFrame:
    out = rows.filter(F.col("kind") == "stat").groupBy("stat").agg(
        F.count_if("action_ok").alias("correct"), F.count("*").alias("total")
    )
    return _scored(out, threshold)


def target_accuracy(rows: DataFrame, threshold: float = C.TARGET_ACCURACY_PASS) -> DataFrame:
    out = rows.agg(F.count_if("target_ok").alias("correct"), F.count_if("target_counts").alias("total"))
    acc = ratio(F.col("correct"), F.col("total"))
    return out.select(
        "correct", "total", rounded(acc, 4).alias("accuracy"),
        ((acc >= threshold) | (F.col("total") == 0)).alias("passed"),
    )


def kind_accuracy(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    out = rows.filter(F.col("kind") == kind).agg(
        F.count_if("action_ok").alias("correct"), F.count("*").alias("total")
    )
    return _scored(out, threshold)


def _scored(counts: DataFrame, threshold: float) -> DataFrame:
    acc = F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double"))
    return counts.withColumn("accuracy", F.coalesce(rounded(acc, 4), F.lit(0.0))).withColumn(
        "passed", F.coalesce(acc >= threshold, F.lit(False))
    )


def action_share(rows: DataFrame, limit: float = C.MAX_ACTION_SHARE) -> DataFrame:
    """One row: actions, total, max_share, passed over the random probes."""
    counts = class_counts(rows.filter(F.col("kind") == "random"), "action")
    top = counts.agg(
        F.count("*").alias("actions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.max("n"), F.lit(0)).alias("_top"),
    )
    share = ratio(F.col("_top"), F.col("total"))
    return top.select("actions", "total", rounded(share, 4).alias("max_share"), (share <= limit).alias("passed"))


def quality_report(rows: DataFrame) -> DataFrame:
    """All sections and the overall verdict in one row, from one pass over the probes.

    Probes are reduced to (kind, stat, action) counts first: the report itself is
    built from that small table.
    """
    cells = rows.groupBy("kind", "stat", "action").agg(
        F.count("*").alias("n"),
        F.count_if("action_ok").alias("ok"),
        F.count_if("target_counts").alias("t_n"),
        F.count_if("target_ok").alias("t_ok"),
    )
    sums = [F.sum("t_ok").alias("t_ok"), F.sum("t_n").alias("t_n")]
    for kind in ("conflict", "absent"):
        here = F.col("kind") == kind
        sums += [
            F.coalesce(F.sum(F.when(here, F.col("ok"))), F.lit(0)).alias(f"{kind}_ok"),
            F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"{kind}_n"),
        ]
    for stat in C.LABEL_STATS:
        here = (F.col("kind") == "stat") & (F.col("stat") == stat)
        sums += [
            F.coalesce(F.sum(F.when(here, F.col("ok"))), F.lit(0)).alias(f"{stat}_ok"),
            F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"{stat}_n"),
        ]
    for action in C.ACTIONS:
        here = (F.col("kind") == "random") & (F.col("action") == action)
        sums.append(F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"n_{action}"))
    flat = cells.agg(*sums)

    def section(ok: Column, n: Column, threshold: float, pass_empty: bool = False) -> Column:
        acc = F.try_divide(ok.cast("double"), n.cast("double"))
        return F.struct(
            ok.alias("correct"),
            n.alias("total"),
            F.coalesce(rounded(acc, 4), F.lit(0.0)).alias("accuracy"),
            F.coalesce(acc >= threshold, F.lit(pass_empty)).alias("pass"),
        )

    per_stat: list[Column] = []
    for stat in C.LABEL_STATS:
        per_stat += [F.lit(stat), section(F.col(f"{stat}_ok"), F.col(f"{stat}_n"), C.STAT_ACCURACY_PASS)]
    counts = [F.col(f"n_{a}") for a in C.ACTIONS]
    total = sum(counts[1:], counts[0])
    top_share = ratio(F.greatest(*counts), total)
    histogram: list[Column] = []
    for action, n in zip(C.ACTIONS, counts):
        histogram += [F.lit(action), n]
    report = flat.select(
        F.create_map(*per_stat).alias("per_stat_accuracy"),
        section(F.col("t_ok"), F.col("t_n"), C.TARGET_ACCURACY_PASS, True).alias("target_accuracy"),
        section(F.col("conflict_ok"), F.col("conflict_n"), C.CONFLICT_ACCURACY_PASS).alias("priority_conflict"),
        section(F.col("absent_ok"), F.col("absent_n"), C.FALLBACK_ACCURACY_PASS).alias("fallback_accuracy"),
        F.map_filter(F.create_map(*histogram), lambda _, n: n > 0).alias("action_distribution"),
        rounded(top_share, 4).alias("max_action_share"),
        top_share.alias("_share"),
    )
    all_stats = F.forall(F.map_values("per_stat_accuracy"), lambda r: r["pass"])
    verdict = (
        all_stats
        & F.col("target_accuracy.pass")
        & F.col("priority_conflict.pass")
        & F.col("fallback_accuracy.pass")
        & (F.col("_share") <= C.MAX_ACTION_SHARE)
    )
    return report.withColumn("pass", verdict).drop("_share")


_SECTION = "struct<correct:bigint,total:bigint,accuracy:double,passed:boolean>"


def rename_pass(report: DataFrame) -> DataFrame:
    """Report with every key ``pass`` renamed to ``passed``, at all depths."""
    section_cols = ("target_accuracy", "priority_conflict", "fallback_accuracy")
    out = report.withColumn("per_stat_accuracy", F.col("per_stat_accuracy").cast(f"map<string,{_SECTION}>"))
    for name in section_cols:
        out = out.withColumn(name, F.col(name).cast(_SECTION))
    return out.withColumnRenamed("pass", "passed")


REPORT_SCHEMA = (
    f"per_stat_accuracy map<string,{_SECTION}>, target_accuracy {_SECTION}, "
    f"priority_conflict {_SECTION}, fallback_accuracy {_SECTION}, "
    "action_distribution map<string,bigint>, max_action_share double, passed boolean"
)


def read_reports(texts: DataFrame, body: str = "body") -> DataFrame:
    """Add ``report``: the parsed report, or null where text or content is not valid."""
    from labelloom.operators.labelling import report_violations

    checked = parse_objects(texts, F.col(body), ["passed"], "_t")
    parsed = checked.withColumn("_r", F.from_json(body, REPORT_SCHEMA, {"allowSingleQuotes": "false"}))
    rated = parsed.withColumn("_broken", F.expr(f"size({report_violations('_r')})"))
    good = F.col("_t_json") & (F.col("_broken") == 0)
    return rated.withColumn("report", F.when(good, F.col("_r"))).select(*texts.columns, "report")
