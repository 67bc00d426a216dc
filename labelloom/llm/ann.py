"""Nearest neighbours with randomly rotated one-bit codes.

Unit vectors are rotated by a seeded random orthogonal matrix and kept as one sign bit per
dimension, with one correction scalar <code, vector>. An estimate of the inner product is
<code, query> / correction, and its error is below eps * sqrt((1 - c^2) / c^2) / sqrt(dim - 1)
except with tiny probability. Rows whose upper bound reaches the k-th best lower bound are
reranked with the original vectors in double precision.

Candidates and queries are cut into blocks of fixed size; each block of queries meets each
block of candidates in a task of its own, and a block pair gives k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import stored
from labelloom.sources.session import ship_package

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
# Width of the error bound; at 4 an estimate leaves its bound about 6 times in 100,000.
EPS = 4.0
SEED = 20240229
FOUND = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"
STEP = 256


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors and their correction scalars."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0))
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows cut into blocks: block id, ids, components one after another (float64), dim."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                dims = np.asarray(pa.compute.list_value_length(part.column("v")))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                starts = np.cumsum(dims) - dims
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    data = flat[starts[mine][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([int(dim)], pa.int32()), "ids": [ids[mine].tobytes()], "data": [data.tobytes()]}
                    )

    return rows.mapInArrow(cut, "dim int, ids binary, data binary").withColumn(
        "block", F.monotonically_increasing_id()
    )


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks of a stored table with numbers from 1; only block ids pass through the window."""
    number = F.row_number().over(W.orderBy("block")).alias(f"{name}_block")
    return blocks.join(blocks.select("block", number), "block").drop("block")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    eps: float = EPS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for each query but itself.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without an id; vectors of different length are not compared. Ties go to the
    smaller id. A repeated id is a row of its own, except that a query never meets its own id.
    """
    ship_package(vectors.sparkSession)
    cand = _numbered(stored(_blocks(_usable(vectors, id_col, vector_col), block_rows), "ann-rows"), "c")
    asked = _numbered(stored(_blocks(_usable(queries, id_col, vector_col), query_rows), "ann-queries"), "q")
    n_cand, n_asked = cand.count(), asked.count()
    if not n_cand or not n_asked:
        return vectors.sparkSession.createDataFrame([], RESULT)
    # the stated query set against all rows, in blocks: one task input for each pair of blocks
    pairs = (
        asked.select("q_block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        .withColumn("c_block", F.explode(F.sequence(F.lit(1), F.lit(n_cand))))
        .join(cand.withColumn("q_block", F.explode(F.sequence(F.lit(1), F.lit(n_asked)))), ["q_block", "c_block"])
        .filter("dim = q_dim")
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            for row in range(b.num_rows):
                dim = b.column("dim")[row].as_py()
                turn = turns.setdefault(dim, rotation(dim))
                q_ids, ids = (np.frombuffer(b.column(c)[row].as_py(), "<i8") for c in ("q_ids", "ids"))
                q, v = (np.frombuffer(b.column(c)[row].as_py(), "<f8").reshape(-1, dim) for c in ("q_data", "data"))
                yield _match_block(q_ids, q, ids, v, turn, k, eps)

    found = pairs.select("dim", "q_ids", "q_data", "ids", "data").mapInArrow(match, FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _match_block(q_ids, q, ids, v, turn, k, eps) -> pa.RecordBatch:
    dim = v.shape[1]
    codes, fix = encode(v, turn)
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.sqrt(np.float32(dim))
    slack = eps * np.sqrt(np.maximum(1 - fix**2, 0) / fix**2) / np.sqrt(max(dim - 1, 1))
    v_norm = np.sqrt((v * v).sum(axis=1))
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), STEP):
        part = q[at : at + STEP]
        turned = ((part / np.linalg.norm(part, axis=1, keepdims=True)) @ turn).astype(np.float32)
        about = (turned @ signs.T) / fix.astype(np.float32)
        low = about - slack.astype(np.float32)
        own = q_ids[at : at + STEP, None] == ids[None, :]
        low[own] = -np.inf
        if len(ids) > k:
            edge = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            edge = np.full(len(part), -np.inf, np.float32)
        keep = (about + slack.astype(np.float32) >= edge[:, None]) & ~own
        for i in range(len(part)):
            near = np.flatnonzero(keep[i])
            query = part[i]
            score = (v[near] * query).sum(axis=1) / (v_norm[near] * np.sqrt((query * query).sum()))
            top = np.lexsort((ids[near], -score))[:k]
            out_q.append(np.full(len(top), q_ids[at + i]))
            out_v.append(ids[near][top])
            out_s.append(score[top])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return pa.RecordBatch.from_pydict(
        {"query_id": join(out_q, "i8"), "vec_id": join(out_v, "i8"), "score": join(out_s, "f8")}
    )
