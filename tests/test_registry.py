"""Registry changes, listings and guards."""

from datetime import datetime

from pyspark.sql import functions as F

from labelloom.operators import listing, registry

SCHEMA = "id string, name string, count int, created_at timestamp_ntz, updated_at timestamp_ntz"
T0, T1, T2 = (datetime(2024, 1, d) for d in (1, 2, 3))


def base(spark):
    return spark.createDataFrame([("a", "one", 1, T0, T0), ("b", "two", None, T0, T0)], SCHEMA)


def now():
    return F.expr("timestamp_ntz'2024-01-03 00:00:00'")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_create_get_delete(spark):
    new = spark.createDataFrame([("c", "three", 3), ("a", "again", 9)], "id string, name string, count int")
    made = by_id(registry.create_rows(base(spark), new, now()))
    assert set(made) == {"a", "b", "c"} and made["a"].name == "one"
    assert made["c"].created_at == made["c"].updated_at == T2
    wanted = spark.createDataFrame([("a",), ("zz",)], "id string")
    got = by_id(registry.get_rows(base(spark), wanted))
    assert got["a"].name == "one" and got["zz"].name is None
    assert set(by_id(registry.delete_rows(base(spark), wanted))) == {"b"}
    assert {r.id: r.deleted for r in registry.deleted_flags(base(spark), wanted).collect()} == {"a": True, "zz": False}


def test_patch_keeps_last_set_value_and_can_set_null(spark):
    rows = [
        ("a", 1, T1, "x", True, 5, False),
        ("a", 2, T1, None, False, None, True),
        ("a", 3, T2, "ignored", False, 7, False),
        ("b", 4, T1, "y", True, None, False),
        ("zz", 5, T2, "no", True, 1, True),
    ]
    changes = spark.createDataFrame(
        rows, "id string, seq int, ts timestamp_ntz, name string, set_name boolean, count int, set_count boolean"
    )
    got = by_id(registry.patch_rows(base(spark), changes, ["name", "count"]))
    assert set(got) == {"a", "b"}
    assert (got["a"].name, got["a"]["count"], got["a"].updated_at, got["a"].created_at) == ("x", None, T1, T0)
    assert (got["b"].name, got["b"]["count"], got["b"].updated_at) == ("y", None, T1)


def test_update_replaces_all_columns(spark):
    changes = spark.createDataFrame([("a", 1, T1, "x", None)], "id string, seq int, ts timestamp_ntz, name string, count int")
    got = by_id(registry.update_rows(base(spark), changes, ["name", "count"]))
    assert (got["a"].name, got["a"]["count"], got["a"].updated_at) == ("x", None, T1)
    assert got["b"].updated_at == T0


def test_one_active_row(spark):
    flags = base(spark).withColumn("is_active", F.col("id") == "a")
    got = by_id(registry.activate_only(flags, F.lit("b"), now()))
    assert {k: r.is_active for k, r in got.items()} == {"a": False, "b": True}
    assert {r.updated_at for r in got.values()} == {T2}
    kept = by_id(registry.activate_only(flags, F.lit("zz"), now()))
    assert {k: (r.is_active, r.updated_at) for k, r in kept.items()} == {"a": (True, T0), "b": (False, T0)}
    assert registry.active_row(flags).first().id == "a"


def test_widen_and_seed(spark):
    wide = registry.widen(base(spark), {"path": ("string", ""), "active": ("boolean", False), "progress": ("double", None)})
    assert {(r.path, r.active, r.progress) for r in wide.collect()} == {("", False, None)}
    new = spark.createDataFrame([("one",), ("four",), ("four",)], "name string")
    rows, counts = registry.insert_if_absent(base(spark), new)
    assert sorted(r.name for r in rows.collect()) == ["four", "four", "one", "two"]
    assert tuple(counts.first()) == (2, 1)


def test_users(spark):
    users = spark.createDataFrame([("u1", "a"), ("u2", "b"), (None, "c")], "user_id string, email string")
    role = spark.createDataFrame([("u1",), ("u1",), (None,)], "user_id string")
    assert {r.email for r in listing.pending(users, role).collect()} == {"b", "c"}
    assert {r.email for r in listing.approved(users, role).collect()} == {"a"}


def test_search_and_overrides(spark):
    rows = spark.createDataFrame([("Alpha", None), ("beta", "uses ALPHA")], "name string, about string")
    assert listing.search(rows, "alpha", ["name", "about"]).count() == 2
    assert listing.search(rows, "", ["name"]).count() == 2
    assert listing.search(rows, "gamma", ["name", "about"]).count() == 0
    asks = spark.createDataFrame([(None, "m"), ("", "m"), ("local", "m"), ("x", "local")], "a string, d string")
    a, d = F.col("a"), F.col("d")
    got = asks.select(
        listing.local_as_empty(listing.null_override(a, d)), listing.local_as_empty(listing.empty_override(a, d))
    ).collect()
    assert [tuple(r) for r in got] == [("m", "m"), ("", "m"), ("", ""), ("x", "x")]


def test_stages(spark):
    states = ["pending", "generating", "training", "evaluating", "exporting", "running", "completed", "failed"]
    board = listing.stage_board(spark.createDataFrame([(s, s) for s in states], "id string, status string")).collect()
    got = {s: [r.state for r in sorted(board, key=lambda r: r.stage_no) if r.id == s] for s in states}
    c, a, p = "completed", "active", "pending"
    assert got == {
        "pending": [p] * 4, "running": [p] * 4, "generating": [a, p, p, p], "training": [c, a, p, p],
        "evaluating": [c, c, a, p], "exporting": [c, c, c, a], "completed": [c] * 4, "failed": ["failed", p, p, p],
    }
