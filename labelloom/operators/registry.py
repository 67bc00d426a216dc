"""Model and run registry as tables: a snapshot plus a log of change rows.

``apply_changes`` folds a batch of changes into the next snapshot. Changes are
reduced per id on the map side, so an id with very many changes is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from labelloom.functions import constants as C


def create_rows(base: DataFrame, new: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Snapshot with new rows added; both time stamps are ``now``.

    Ids come with the rows, so that a recomputed task gives the same ones. A known
    id is left alone. Columns that ``new`` lacks are null.
    """
    fresh = new.join(base.select(key), key, "left_anti")
    stamped = fresh.withColumn("created_at", now).withColumn("updated_at", now)
    return base.unionByName(stamped, allowMissingColumns=True)


def get_rows(base: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows for a table of ids; an unknown id gives nulls."""
    return wanted.select(key).distinct().join(base, key, "left")


def delete_rows(base: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def deleted_flags(base: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Per requested id whether a row existed."""
    known = base.select(key, F.lit(True).alias("_known"))
    return gone.select(key).distinct().join(known, key, "left").select(
        key, F.col("_known").isNotNull().alias("deleted")
    )


def patch_rows(
    base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", seq: str = "seq", ts: str = "ts"
) -> DataFrame:
    """Snapshot with the last set value per column.

    ``set_<column>`` in ``changes`` says whether a change touches the column, since
    null may be the new value. updated_at becomes the time of the last change;
    created_at stays. Changes to unknown ids have no effect.
    """
    touched = [F.col(f"set_{c}") for c in columns]
    any_set = touched[0]
    for flag in touched[1:]:
        any_set = any_set | flag
    last = changes.filter(any_set).groupBy(key).agg(
        *[
            F.max_by(F.when(F.col(f"set_{c}"), F.struct(F.col(c))), F.when(F.col(f"set_{c}"), F.col(seq))).alias(f"_{c}")
            for c in columns
        ],
        F.max_by(ts, seq).alias("_ts"),
    )
    joined = base.join(last, key, "left")
    out = []
    for name in base.columns:
        if name in columns:
            change = F.col(f"_{name}")
            out.append(F.when(change.isNotNull(), change[name]).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            out.append(F.coalesce("_ts", "updated_at").alias("updated_at"))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def update_rows(base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Snapshot with all config columns replaced by those of the last change."""
    flagged = changes
    for c in columns:
        flagged = flagged.withColumn(f"set_{c}", F.lit(True))
    return patch_rows(base, flagged, columns, key, seq, ts)


def activate_only(base: DataFrame, chosen: Column, now: Column, key: str = "id") -> DataFrame:
    """Exactly the chosen row active, all rows stamped; an unknown id changes nothing."""
    found = F.coalesce(
        base.agg(F.max((F.col(key) == chosen).cast("int")).alias("f")).scalar(), F.lit(0)
    ) == 1
    return base.withColumn(
        "is_active", F.when(found, F.col(key) == chosen).otherwise(F.col("is_active"))
    ).withColumn("updated_at", F.when(found, now).otherwise(F.col("updated_at")))


def active_row(base: DataFrame, key: str = "id") -> DataFrame:
    """The active row, if any."""
    return base.filter("is_active").orderBy(key).limit(1)


def finalise(base: DataFrame, verdicts: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """Runs with eval value and final status from one verdict (passed, valid_pct) per run."""
    v = verdicts.select(
        key,
        F.col("passed").alias("_passed"),
        F.col("valid_pct").alias("_pct"),
        F.col(ts).alias("_ts"),
    )
    done = F.col("_passed").isNotNull()
    return base.join(v, key, "left").select(
        *[
            {
                "status": F.when(F.col("_passed"), "completed").when(done, "failed").otherwise(F.col("status")).alias("status"),
                "eval_valid_pct": F.when(done, F.col("_pct")).otherwise(F.col("eval_valid_pct")).alias("eval_valid_pct"),
                "updated_at": F.coalesce("_ts", "updated_at").alias("updated_at"),
            }.get(name, F.col(name))
            for name in base.columns
        ]
    )


def widen(old: DataFrame, defaults: dict[str, tuple[str | DataType, object]]) -> DataFrame:
    """Old rows with later columns added; each gets its declared default or null."""
    out = old
    for name, (kind, value) in defaults.items():
        if name not in old.columns:
            out = out.withColumn(name, F.lit(value).cast(kind))
    return out


def checked_runs(rows: DataFrame) -> DataFrame:
    """Typed registry rows with a mark for unknown status values."""
    return rows.withColumn("status_known", F.coalesce(F.col("status").isin(C.RUN_STATUSES), F.lit(False)))


def insert_if_absent(existing: DataFrame, new: DataFrame, on: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and counts of created and skipped rows."""
    known = existing.select(on).distinct()
    marked = new.join(known.withColumn("_known", F.lit(True)), on, "left")
    created = marked.filter(F.col("_known").isNull()).drop("_known")
    counts = marked.agg(
        F.count_if(F.col("_known").isNull()).alias("created"),
        F.count_if(F.col("_known").isNotNull()).alias("skipped"),
    )
    return existing.unionByName(created, allowMissingColumns=True), counts
