"""Snapshots in buckets: a patch moves its changes and leaves the snapshot where it is."""

from plans import plan_text
from pyspark.sql import functions as F

from labelloom.operators import registry
from labelloom.sources import store


def test_a_patch_does_not_move_the_snapshot(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('s', id) as status", "timestamp'2024-01-01' as updated_at")
    base = store.save_snapshot(rows, "snap", buckets=16)
    changes = spark.range(500).selectExpr(
        "id * 7 as id", "id as seq", "timestamp'2024-02-01' as ts", "'new' as status", "id % 2 = 0 as set_status"
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = registry.patch_rows(base, store.aligned(changes, buckets=16), ["status"])
        plan = plan_text(out)
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 16 out of 16" in plan and "SortMergeJoin" in plan
        got = {r["id"]: r["status"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: "new" if i % 14 == 0 and i < 3500 else f"s{i}" for i in range(20_000)}
    assert base.filter(F.col("id") == 77).first()["status"] == "s77"
