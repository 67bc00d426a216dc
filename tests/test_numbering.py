"""Numbers, totals and exact draws over whole tables, with holes, ties, hot rows and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import generate, numbering, quality, resample


def test_dense_numbers_over_holes_and_ties(spark):
    ids = spark.range(3000).selectExpr("id * id as id", "id % 3 as same").repartition(7)
    rows = numbering.numbered(ids, "id").orderBy("place").collect()
    assert [(r["place"], r["id"]) for r in rows] == [(n, n * n) for n in range(3000)]
    ties = numbering.numbered(ids, "same", many_ties=True).collect()
    assert sorted(r["place"] for r in ties) == list(range(3000))
    assert [r["same"] for r in sorted(ties, key=lambda r: r["place"])] == sorted(r["same"] for r in ties)
    assert numbering.numbered(ids.limit(0), "id").count() == 0


def test_stratify_is_exact_for_ids_with_holes(spark):
    for n in (0, 3, 503):
        ids = spark.range(n).selectExpr("id * 35 + 2 as request_id")
        counts = Counter(r["dominant"] for r in generate.stratify_exactly(ids).collect())
        stats = ["hunger", "tiredness", "boredom", "social", "toilet"]
        assert counts == Counter({s: n // 5 + (k < n % 5) for k, s in enumerate(stats)})


def test_rows_are_paired_by_position(spark):
    left = spark.createDataFrame([(i * 3, f"l{i}", 1) for i in range(50)], "id long, name string, place int").repartition(5)
    right = spark.createDataFrame([(100 - i, f"r{i}") for i in range(70)], "id long, name string").repartition(3)
    rows = numbering.zip_rows(left, ["id"], right, ["id"]).orderBy("place").collect()
    assert [(r["left"]["name"], r["right"]["name"]) for r in rows] == [(f"l{i}", f"r{69 - i}") for i in range(50)]


def test_exactly_n_draws_in_proportion(spark):
    df = spark.range(4000).selectExpr("id", "case when id % 20 = 0 then 'rare' when id % 3 = 0 then 'mid' else 'many' end as c")
    drawn = resample.resample_exactly(quality.class_weights(df, "c"), 1, "id")
    rows = drawn.collect()
    counts = Counter(r.c for r in rows)
    assert len(rows) == 4000 and all(n == pytest.approx(4000 / 3, rel=0.12) for n in counts.values())
    assert max(Counter((r.id, r.copy) for r in rows).values()) == 1
    again = resample.resample_exactly(quality.class_weights(df.repartition(3), "c"), 1, "id").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    assert resample.resample_exactly(quality.class_weights(df, "c"), 2, "id", n=7).count() == 7


def test_a_heavy_row_is_drawn_by_many_tasks(spark):
    odd = [(1, 1e9), (2, 0.5), (3, 0.0), (4, None), (5, float("nan")), (6, -1.0), (1, 1e9), (None, 5e8)]
    df = spark.createDataFrame(odd, "id long, weight double")
    drawn = resample.resample_exactly(df, 3, "id", n=30_000)
    copies = Counter(r.id for r in drawn.collect())
    assert sum(copies.values()) == 30_000 and set(copies) <= {1, 2, None}
    assert copies[1] == pytest.approx(24_000, rel=0.05) and copies[None] == pytest.approx(6_000, rel=0.1)
    parts = drawn.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 20_000


def test_draws_from_nothing(spark):
    df = spark.createDataFrame([(1, 0.0)], "id long, weight double")
    assert resample.resample_exactly(df.limit(0), 1, "id").count() == 0
    with pytest.raises(ValueError, match="no row has a weight"):
        resample.resample_exactly(df, 1, "id")
    with pytest.raises(ValueError, match="finite"):
        resample.resample_exactly(df.withColumn("weight", F.lit(float("inf"))), 1, "id")
