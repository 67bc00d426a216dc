"""Centroid clustering of integer vectors by a tournament of bisectors.

Vector components become whole numbers, so every comparison is exact. For centroids i < j the
points nearer to j are those with normal . x > threshold, where the normal is 2 (j - i) and the
threshold |j|^2 - |i|^2. A vector starts with centroid 0 and meets the others in order; k - 1
such sign tests leave one, and a zero favours the smaller number. Only then is the distance to
the one that is left worked out.

A round is one pass over the stored vectors. Each task adds up its vectors per centroid, Spark
adds these few rows, and k rows of sums reach the driver, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stored
from labelloom.sources.session import ship_package

DIMS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
# Whole components are held within this bound, so that squared distances fit into 64 bits.
LIMIT = 1 << 27
# Rows that are compared at once; their gathered normals stay near 2 MB.
BLOCK = 4096


class Bisectors:
    """Normals and thresholds of all pairs of a few centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        c = self.centroids = np.asarray(centroids, np.int64)
        sizes = np.einsum("id,id->i", c, c)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = sizes[None, :] - sizes[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row; of equally near ones the smallest."""
        left = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normals[left, j]) - self.thresholds[left, j]
            left[side > 0] = j
        return left

    def distances(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[numbers]
        return np.einsum("nd,nd->n", gap, gap)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), _matrix(part.column(1)).astype(np.int64)


def integer_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE
) -> DataFrame:
    """vec_id and ``v``, the floors of the scaled components; other vectors take no part.

    Kept are vectors of exactly ``dims`` components, none null, infinite or not a number.
    Floors beyond ``LIMIT`` become ``LIMIT`` with their sign.
    """
    ship_package(rows.sparkSession)
    taken = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1))
            fitting = batch.filter(pa.compute.equal(sizes, dims).fill_null(False))
            if not fitting.num_rows:
                continue
            x = _matrix(fitting.column(1))
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(x[good] * scale), -LIMIT, LIMIT).astype(np.int32)
            starts = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays(
                [fitting.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(starts, pa.array(v.ravel()))],
                names=["vec_id", "v"],
            )

    id_type = taken.schema["vec_id"].dataType.simpleString()
    return taken.mapInArrow(whole, f"vec_id {id_type}, v array<int>")


def first_centroids(vectors: DataFrame, k: int, seed: int | str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id; ties by components, no id last.

    A threshold that some hundreds of rows are expected below keeps what tasks send on small;
    should fewer than k be below it, all rows are ordered.
    """
    n = vectors.count()
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    placed = vectors.select(place.alias("place"), "v")
    share = (4 * k + 400) / max(n, 1)
    for below in (f"{int(share * 2**32):08x}" if share < 1 else None, None):
        some = placed.filter(F.col("place") < below) if below else placed
        found = some.orderBy(F.asc_nulls_last("place"), "v").limit(k).collect()
        if len(found) == min(k, n):
            break
    return np.array([r["v"] for r in found], np.int64) if found else np.zeros((0, 1), np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of the mean of its vectors; one without any stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bisectors(centroids)
        sums = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
        for _, x in _blocks(batches):
            numbers = table.nearest(x)
            np.add.at(sums[:, 0], numbers, 1)
            for number in np.unique(numbers):
                sums[number, 1:] += x[numbers == number].sum(axis=0)
        held = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    parts = vectors.mapInArrow(add, "cluster int, sums array<bigint>")
    total = F.sum(F.col("part").cast("decimal(38,0)"))
    sums = (
        parts.select("cluster", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(total.alias("total"))
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("sums"))
    )
    out = centroids.copy()
    for row in sums.collect():
        n, *totals = (int(s["total"]) for s in row["sums"])
        out[row["cluster"]] = [t // n for t in totals]
    return out


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int | str = SEED) -> np.ndarray:
    """Centroids after ``rounds`` rounds, one row each; fewer than k if there are fewer vectors."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bisectors(centroids)
        for ids, x in _blocks(batches):
            numbers = table.nearest(x)
            distances = table.distances(x, numbers)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(numbers.astype(np.int32)), pa.array(distances)], names=["vec_id", "cluster", "distance"]
            )

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(near, f"vec_id {id_type}, cluster int, distance bigint")


def centroid_clusters(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int | str = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and ``centroid``, per vector that takes part.

    Rows that repeat an id are vectors of their own; a vector without an id takes part and is
    taken as a first centroid only if all others are. Equal centroids may occur, the later ones
    then stay empty and where they are. Sums of distances beyond 64 bits are null. A table
    without fitting vectors gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows, id_col, vec_col, dims, scale), "integer-vectors")
    centroids = fit(vectors, k, rounds, seed)
    near = stored(assign(vectors, centroids), "assigned-vectors")
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda n: n if n < 1 << 63 else None
    inertia = fits(sum(int(r["s"]) for r in sums))
    facts = [(r["cluster"], fits(int(r["s"])), inertia, centroids[r["cluster"]].tolist()) for r in sums]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    # k rows at most
    return near.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")
