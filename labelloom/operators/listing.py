"""Listings and lookups over users, models and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import constants as C
from labelloom.functions.text import contains_any


def search(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    return rows.filter(contains_any([F.col(c) for c in columns], needle))


def by_key(rows: DataFrame, column: str, value: object | None = None) -> DataFrame:
    return rows if value is None else rows.filter(F.col(column) == F.lit(value))


def pending(users: DataFrame, approved: DataFrame, on: str = "user_id") -> DataFrame:
    return users.join(approved.select(on).distinct(), on, "left_anti")


def approved(users: DataFrame, holders: DataFrame, on: str = "user_id") -> DataFrame:
    return users.join(holders.select(on).distinct(), on, "left_semi")


def union_pages(pages: list[DataFrame]) -> DataFrame:
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def local_as_empty(backend: Column) -> Column:
    return F.when(backend == "local", "").otherwise(backend)


def null_override(asked: Column, default: Column) -> Column:
    """Request value unless null."""
    return F.coalesce(asked, default)


def empty_override(asked: Column, default: Column) -> Column:
    """Request value unless null or empty."""
    return F.coalesce(F.nullif(asked, F.lit("")), default)


def run_guard(status: Column) -> Column:
    """Empty when a run may be activated, else the reason."""
    reason = F.concat(F.lit("Run has not completed successfully (status="), status, F.lit(")"))
    return F.when(status == "completed", "").otherwise(reason)


def model_guard(artifact: Column) -> Column:
    empty = artifact.isNull() | (artifact == "")
    return F.when(empty, "Model has no exported artifact yet").otherwise("")


def stage_board(runs: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    """Four rows per run with the state of each stage."""
    now = F.coalesce(F.element_at(F.create_map(*[
        c for name, i in C.STAGE_OF_STATUS.items() for c in (F.lit(name), F.lit(i))
    ]), F.col(status)), F.lit(-1))
    stages = F.posexplode(F.array(*[F.lit(n) for n in C.STAGE_NAMES]))
    rows = runs.select(key, status, now.alias("_now"), stages.alias("stage_no", "stage"))
    state = (
        F.when(F.col(status) == "completed", "completed")
        .when((F.col(status) == "failed") & (F.col("stage_no") == 0), "failed")
        .when(F.col("stage_no") < F.col("_now"), "completed")
        .when(F.col("stage_no") == F.col("_now"), "active")
        .otherwise("pending")
    )
    return rows.select(key, "stage_no", "stage", state.alias("state"))
