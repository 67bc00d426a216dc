"""Hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given hashed features of the tokens before
it (the last one, the two last ones as a pair, and single ones two and three places back)
times that of the token within its class, from counts with one added. Classes come from
the data: the cluster of texts a word is most typical of, and its frequency band.

1. Documents become chunks of coded tokens, written once; frequent words and text clusters
   are found from these. Chunks send their distinct words with counts to buckets of words;
   there the counts meet, and each chunk gets its words' totals and classes back by position.
2. Every task takes gradient steps over its chunks of training texts from the common
   weights; weights are averaged over tasks, each row by how often it was used. The first
   round takes one chunk in eight, the second starts from its weights and takes the others.
3. Texts are scored in sparse numpy batches.

Frequent words, centres of the text clusters, counts, classes and weights come from all
training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import LOWER, discard, id_and_text, release, reread, slices
from labelloom.llm.hashing import Rolling, mix, word_spans
from labelloom.sources.session import work_path

CLUSTERS = 8
BANDS = 4
CLASSES = CLUSTERS * BANDS
FEATURES = 1 << 15
BLOCKS = 128
LAGS = 3
RATE = 0.5
MINI = 8192
TOP_WORDS = 256
PROFILE_ROWS = 4096
CENTRE_ROUNDS = 10
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64
# Class of words never seen in training: the rarest band of the first cluster.
UNSEEN = BANDS - 1

CHUNK = "chunk long, ids array<long>, train binary, sizes binary, codes binary, words binary, hashes binary"
REQUEST = "bucket int, chunk long, words binary, counts binary"
ANSWER = "bucket int, chunk long, counts binary, classes binary, sums array<long>"
CODED = ("chunk long, ids array<long>, train binary, sizes binary, codes binary, tokens binary, counts binary, "
         "classes binary")
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def _tokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, starts and stops of the words, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = b"\n".join(raw).translate(LOWER)
    starts, stops = word_spans(np.frombuffer(buffer, np.uint8))
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return buffer, starts, stops, np.diff(np.searchsorted(starts, edges))


def text_clusters(docs: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of all training texts, and centres of the texts' profiles over them."""
    parts, at = _writer(docs.sparkSession)(chunks(docs), "lm-chunks")
    found = chunk_clusters(parts)
    discard(docs.sparkSession, at)
    return found


def chunk_clusters(stored_chunks: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """``text_clusters`` from stored chunks.

    Profiles are written once. Spherical k-means starts from the signs of the profiles' main
    directions; each round is one pass that adds up sums of a fixed size.
    """
    spark, parts = stored_chunks.sparkSession, stored_chunks.select("train", "sizes", "codes", "words")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for train, sizes, codes, seen in _texts(batches):
            n = np.bincount(codes[np.repeat(train, sizes)], minlength=len(seen))
            n[0] = 0  # ends of texts are no words
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([seen[i] for i in used.tolist()], pa.binary()), pa.array(n[used], pa.int64())], ["word", "n"])

    counts = parts.mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()]
    place, width = {w: i for i, w in enumerate(top)}, max(1, len(top))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for train, sizes, codes, seen in _texts(batches):
            x = _counts_of(place, width, sizes, codes, seen)[train]
            x = x[x.any(axis=1)].astype("<u4")
            rows = [x[i : i + PROFILE_ROWS].tobytes() for i in range(0, len(x), PROFILE_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["profiles"])

    stored, at = _writer(spark)(parts.mapInArrow(profiles, "profiles binary"), "lm-profiles")
    moments = _sums(stored, width, lambda x: np.vstack([x.T @ x, x.sum(axis=0), np.full(width, len(x))]))
    centres = first_centres(moments[:-2], moments[-2], moments[-1, 0])
    for _ in range(CENTRE_ROUNDS if centres.any() else 0):
        sums = _sums(stored, width, lambda x, c=centres: _by_centre(x, c))
        before, centres = centres, np.where(sums.any(axis=1, keepdims=True), _profile(sums**2), centres)
        if np.abs(centres - before).max() < 1e-4:
            break
    discard(spark, at)
    return top, centres


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Training marks, sizes, codes and the words they stand for of each stored chunk."""
    for b in batches:
        for row in range(b.num_rows):
            train, sizes, codes = (np.frombuffer(b.column(c)[row].as_py(), k) for c, k in (("train", bool), ("sizes", "<u4"), ("codes", "<u4")))
            yield train, sizes, codes, b.column("words")[row].as_py().split(b"\n")


def _counts_of(place: dict[bytes, int], width: int, sizes: np.ndarray, codes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """How often each frequent word stands in each text."""
    known = np.array([place.get(w, -1) for w in words])[codes]
    cells = np.repeat(np.arange(len(sizes)) * width, sizes) + known
    return np.bincount(cells[known >= 0], minlength=len(sizes) * width).reshape(-1, width)


def _clusters(top: list[bytes], centres: np.ndarray) -> Callable[..., np.ndarray]:
    """The cluster of each text of a chunk, from its sizes, codes and words."""
    place, width = {w: i for i, w in enumerate(top)}, len(centres[0])
    return lambda *texts: (_profile(_counts_of(place, width, *texts)) @ centres.T).argmax(axis=1)


def cluster_tokens(stored_chunks: DataFrame, top: list[bytes], centres: np.ndarray) -> np.ndarray:
    """Tokens of training texts in each cluster."""
    cluster_of = _clusters(top, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLUSTERS, np.int64)
        for train, sizes, *rest in _texts(batches):
            total += np.bincount(cluster_of(sizes, *rest)[train], weights=sizes[train], minlength=CLUSTERS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLUSTERS), pa.int32()), pa.array(total)], ["cluster", "n"])

    found = stored_chunks.select("train", "sizes", "codes", "words").mapInArrow(run, "cluster int, n long")
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(k, 0) for k in range(CLUSTERS)], np.int64)


def _by_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of the profiles that are nearest to each centre."""
    mine = (x @ centres.T).argmax(axis=1)
    return np.stack([x[mine == k].sum(axis=0) for k in range(len(centres))])


def _sums(stored: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` (rows of ``width`` numbers) of all stored profiles, added up by blocks of rows."""
    kind, rows = "block int, sums binary", 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for data in b.column("profiles"):
                total = total + of(_profile(np.frombuffer(data.as_py(), "<u4").reshape(-1, width).astype(float)))
        if isinstance(total, np.ndarray):
            parts = [total[i : i + rows].tobytes() for i in range(0, len(total), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in t.column("sums"))
        return pa.table({"block": t.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = stored.mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).collect()
    if not found:
        return of(np.zeros((0, width)))
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, width) for r in sorted(found, key=lambda r: r["block"])])


def first_centres(products: np.ndarray, total: np.ndarray, n: float) -> np.ndarray:
    """Points around the mean, one for each choice of signs of the main directions of the profiles."""
    width = len(total)
    if not n:
        return np.zeros((CLUSTERS, width))
    mean = total / n
    spread, along = np.linalg.eigh(products / n - np.outer(mean, mean))
    centres = np.tile(mean, (CLUSTERS, 1))
    for i in range(min(CLUSTERS.bit_length() - 1, width)):
        v = along[:, -1 - i]
        v = v * np.sign(v[np.abs(v).argmax()]) * np.sqrt(max(spread[-1 - i], 0.0))
        centres += np.where(np.arange(CLUSTERS)[:, None] >> i & 1, -v, v)
    centres = np.maximum(centres, 0)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def _profile(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def chunks(docs: DataFrame) -> DataFrame:
    """Coded chunks: token codes (0 ends a text) and the words they stand for, one line each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, count = Rolling(), 0
        task = TaskContext.get().partitionId()
        for b in slices(batches, limit=CHUNK_BYTES):
            ids = b.column("doc_id").to_pylist()
            buffer, starts, stops, sizes = _tokens(b.column("text").to_pylist())
            rolling.read(np.frombuffer(buffer, np.uint8))
            hashes, first, codes = np.unique(rolling.spans(starts, stops), return_index=True, return_inverse=True)
            # frequent words get small codes, which compress well
            order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes, first, codes = hashes[order], first[order], rank[codes]
            words = [buffer[i:j] for i, j in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            doc = np.repeat(np.arange(len(ids)), sizes)
            all_codes = np.zeros(len(codes) + len(ids), np.uint32)
            all_codes[np.arange(len(codes)) + doc] = codes + 1
            train = np.array([is_training(i) for i in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 *[pa.array([x.tobytes()], pa.binary()) for x in (train, (sizes + 1).astype("<u4"), all_codes)],
                 pa.array([b"\n".join([b"", *words])], pa.binary()),
                 pa.array([np.concatenate([[1], hashes >> np.uint64(32)]).astype("<u4").tobytes()], pa.binary())],
                ["chunk", "ids", "train", "sizes", "codes", "words", "hashes"],
            )
            count += 1

    return docs.mapInArrow(run, CHUNK)


def requests(stored_chunks: DataFrame, buckets: int, top: list[bytes], centres: np.ndarray) -> DataFrame:
    """Words of each chunk by bucket, with their counts in training texts of each cluster."""
    cluster_of = _clusters(top, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (train, sizes, codes, words) in enumerate(_texts([b])):
                cluster = np.repeat(cluster_of(sizes, codes, words), sizes)
                used = np.repeat(train, sizes)
                cells = codes[used].astype(np.int64) * CLUSTERS + cluster[used]
                counts = np.bincount(cells, minlength=len(words) * CLUSTERS).reshape(-1, CLUSTERS).astype("<u4")
                bucket = np.frombuffer(b.column("hashes")[row].as_py(), "<u4").astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [
                    (k, order[starts[k] : starts[k + 1]]) for k in range(buckets) if starts[k] < starts[k + 1]
                ]
                chunk = b.column("chunk")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                     pa.array([b"\n".join([words[i] for i in at]) for _, at in rows], pa.binary()),
                     pa.array([counts[at].T.tobytes() for _, at in rows], pa.binary())], ["bucket", "chunk", "words", "counts"],
                )

    columns = ["chunk", "codes", "sizes", "train", "words", "hashes"]
    return stored_chunks.select(columns).mapInArrow(run, REQUEST)


def answers(asked: DataFrame, total: int, by_cluster: np.ndarray) -> DataFrame:
    """Totals and classes of the words of each request, in its order, and sums per class."""
    share = np.maximum(by_cluster, 1) / max(total, 1)

    def run(t: pa.Table) -> pa.Table:
        words = [x.split(b"\n") for x in t.column("words").to_pylist()]
        sizes = [len(w) for w in words]
        coded = pa.array([w for part in words for w in part], pa.binary()).dictionary_encode()
        at = coded.indices.to_numpy()
        counts = np.concatenate(
            [np.frombuffer(x, "<u4").reshape(CLUSTERS, -1).T for x in t.column("counts").to_pylist()]
        )
        n = len(coded.dictionary)
        sums = np.stack([np.bincount(at, weights=counts[:, k], minlength=n) for k in range(CLUSTERS)], axis=1).astype(np.int64)
        c = sums.sum(axis=1)
        kind = classes_of(c, sums, total, share)
        per_class = np.concatenate([
            np.bincount(kind[c > 0], weights=c[c > 0], minlength=CLASSES), np.bincount(kind[c > 0], minlength=CLASSES)
        ]).astype(np.int64)
        edges = np.cumsum([0, *sizes])
        cut = lambda x: [x[at[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("classes", pa.binary()),
                            ("sums", pa.list_(pa.int64()))])
        return pa.table([
            pa.array([*t.column("bucket").to_pylist(), None], pa.int32()), pa.array([*t.column("chunk").to_pylist(), None], pa.int64()),
            pa.array([*cut(c.astype("<i8")), None], pa.binary()), pa.array([*cut(kind.astype(np.uint8)), None], pa.binary()),
            pa.array([None] * len(sizes) + [per_class.tolist()], pa.list_(pa.int64())),
        ], schema=schema)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def classes_of(c: np.ndarray, by_cluster: np.ndarray, total: int, share: np.ndarray) -> np.ndarray:
    """Cluster a word is most typical of, and its frequency band; words never seen share one class."""
    band = np.searchsorted([-1e-3, -1e-4, -1e-5], -c / max(total, 1), side="left")
    cluster = ((by_cluster + 0.5 * share) / share).argmax(axis=1)
    return np.where(c > 0, cluster * BANDS + band, UNSEEN)


def coded(stored_chunks: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    """Chunks with the hash, count and class of every word, in place of the words."""
    back = answered.filter("chunk is not null").groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "counts", "classes")).alias("answers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                hashes = np.frombuffer(b.column("hashes")[row].as_py(), "<u4")
                bucket = hashes.astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                found = sorted(b.column("answers")[row].as_py(), key=lambda x: x["bucket"])
                counts, kinds = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.uint8)
                counts[order] = np.frombuffer(b"".join(x["counts"] for x in found), "<i8")
                kinds[order] = np.frombuffer(b"".join(x["classes"] for x in found), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(row, 1) for c in ("chunk", "ids", "train", "sizes", "codes", "hashes")],
                     *[pa.array([x.tobytes()], pa.binary()) for x in (counts, kinds)]],
                    ["chunk", "ids", "train", "sizes", "codes", "tokens", "counts", "classes"],
                )

    columns = ["chunk", "ids", "train", "sizes", "codes", "hashes", "answers"]
    return stored_chunks.join(back, "chunk").select(columns).mapInArrow(run, CODED)


def feature_rows(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of each token, from the tokens before it; row 0 of the weights is always on."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(tokens))
    lagged = []
    for lag in range(1, LAGS + 1):
        back = at - lag
        lagged.append(np.where(back >= first, tokens[np.maximum(back, 0)].astype(np.uint64), np.uint64(0)))
    rows = [mix(x * np.uint64(8) + np.uint64(i + 1)) for i, x in enumerate(lagged)]
    rows.append(mix(mix(lagged[0]) + lagged[1] * np.uint64(8) + np.uint64(7)))
    return np.stack([(r % np.uint64(FEATURES - 1) + np.uint64(1)).astype(np.uint16) for r in rows], axis=1)


def class_log(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities of all classes."""
    logits = weights.take(rows[:, 0], axis=0)
    for i in range(1, rows.shape[1]):
        logits += weights.take(rows[:, i], axis=0)
    logits += weights[0]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _chunk_arrays(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    kinds = (("train", bool), ("sizes", "<u4"), ("codes", "<u4"), ("tokens", "<u4"), ("counts", "<i8"), ("classes", np.uint8))
    train, sizes, codes, *words = (np.frombuffer(b.column(c)[row].as_py(), k) for c, k in kinds)
    return train, sizes.astype(np.int64), *[x[codes] for x in words]


def sums_of_runs(rows: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``np.add.reduceat`` over the first axis, bit by bit, which is slow where most runs are short.

    It adds to a run's first row the sum of the others, those in order if they are fewer than eight.
    """
    out, longest = rows.take(first, axis=0), 8
    by = np.argsort(-np.minimum(times, longest + 1), kind="stable")
    n = [np.count_nonzero(times > k) for k in range(longest + 1)]
    rest = rows.take(first[by[n[longest] : n[1]]] + 1, axis=0)
    for k in range(2, longest):
        rest[: n[k] - n[longest]] += rows.take(first[by[n[longest] : n[k]]] + k, axis=0)
    out[by[n[longest] : n[1]]] += rest
    if n[longest]:
        long = times > longest
        edges = np.cumsum(times[long]) - times[long]
        out[long] = np.add.reduceat(rows[np.repeat(long, times)], edges, axis=0)
    return out


def learn(weights: np.ndarray, used: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """Gradient steps over mini-batches, in place; ``used`` counts how often each row took part."""
    for at in range(0, len(rows), MINI):
        part, goal = rows[at : at + MINI], target[at : at + MINI]
        error = np.exp(class_log(weights, part))
        error[np.arange(len(goal)), goal] -= 1
        flat = part.ravel()
        order = np.argsort(flat, kind="stable")
        sorted_rows = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = sorted_rows[1:] != sorted_rows[:-1]
        first = np.flatnonzero(new)
        mine = sorted_rows[first]
        times = np.diff(np.append(first, len(flat)))
        pull = sums_of_runs(error.take(order // part.shape[1], axis=0), first, times)
        used[mine] += times
        weights[mine] -= (RATE * pull / (np.sqrt(times) * np.sqrt(used[mine]))[:, None]).astype(np.float32)
        used[0] += len(goal)
        weights[0] -= (RATE * error.sum(axis=0) / np.sqrt(len(goal) * used[0])).astype(np.float32)


def train_round(data: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights after all tasks took steps over their part of the data, averaged by use."""
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # FEATURES * CLASSES numbers, whatever the data
    height = FEATURES // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used = shared.value.copy(), np.zeros(FEATURES)
        for b in batches:
            for row in range(b.num_rows):
                train, sizes, tokens, _, classes = _chunk_arrays(b, row)
                mask = np.repeat(train, sizes)
                if mask.any():
                    learn(own, used, feature_rows(tokens[mask], sizes[train]), classes[mask].astype(np.int64))
        if used.any():
            parts = [slice(k * height, (k + 1) * height) for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BLOCKS, dtype=np.int32)),
                 pa.array([(own[p] * used[p, None]).astype("<f4").tobytes() for p in parts], pa.binary()),
                 pa.array([used[p].astype("<f4").tobytes() for p in parts], pa.binary())], ["block", "sums", "used"],
            )

    def add(t: pa.Table) -> pa.Table:
        sums, used = np.zeros((height, CLASSES)), np.zeros(height)
        for s, u in zip(t.column("sums"), t.column("used"), strict=True):
            sums += np.frombuffer(s.as_py(), "<f4").reshape(height, CLASSES)
            used += np.frombuffer(u.as_py(), "<f4")
        return pa.table({"block": t.column("block").slice(0, 1), "sums": pa.array([sums.astype("<f4").tobytes()], pa.binary()),
                         "used": pa.array([used.astype("<f4").tobytes()], pa.binary())})

    kind = "block int, sums binary, used binary"
    out = weights.copy()
    for r in data.mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).collect():
        used = np.frombuffer(r["used"], "<f4")
        mean = np.frombuffer(r["sums"], "<f4").reshape(height, CLASSES) / np.maximum(used, 1e-9)[:, None]
        part = slice(r["block"] * height, (r["block"] + 1) * height)
        out[part] = np.where(used[:, None] > 0, mean, out[part])
    return out


def score_chunks(data: DataFrame, weights: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(weights)
    total, words = int(class_tokens.sum()), int(class_words.sum())
    room = class_tokens + class_words + (np.arange(CLASSES) == UNSEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_room, log_all = np.log10(np.maximum(room, 1)), np.log10(total + words + 1)
        for b in batches:
            for row in range(b.num_rows):
                train, sizes, tokens, counts, classes = _chunk_arrays(b, row)
                rows = feature_rows(tokens, sizes)
                fine = np.log10(counts + 1.0)
                own = np.empty(len(tokens))
                for at in range(0, len(rows), MINI):
                    part = slice(at, at + MINI)
                    logs = class_log(shared.value, rows[part])
                    own[part] = logs[np.arange(len(logs)), classes[part]] / np.log(10)
                own += fine - log_room[classes]
                edges = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, edges) if len(edges) else x  # noqa: B023, E731
                n = sizes.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(row, 1).flatten(), pa.array(~train), pa.array(n), pa.array(add((counts > 0).astype(np.int64))),
                     pa.array(np.full(len(n), total, np.int64)), pa.array(add(fine) - n * log_all), pa.array(add(own))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return data.mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: their only token is the end. A null id counts as the text "None"
    when the training part is chosen. Repeated rows are separate texts. Without training
    texts nothing is known, and all words share the class of unseen ones.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, size // BUCKET_BYTES))
    write = _writer(spark)
    parts, at = write(chunks(rows), "lm-chunks")
    clusters = chunk_clusters(parts)
    by_cluster = cluster_tokens(parts, *clusters)
    total = int(by_cluster.sum())
    answered, answered_at = write(answers(requests(parts, buckets, *clusters), total, by_cluster), "lm-answers")
    release(spark)
    per_class = np.zeros(2 * CLASSES, np.int64)
    counted = answered.filter("sums is not null").select(F.posexplode("sums").alias("at", "n"))
    for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
        per_class[r["at"]] = r["n"]
    data, _ = write(coded(parts, answered, buckets), "lm-coded")
    discard(spark, at, answered_at)
    release(spark)
    first = F.pmod(F.xxhash64("chunk"), F.lit(8)) == 0
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for part in (data.filter(first), data.filter(~first)):
        weights = train_round(part, weights)
    return score_chunks(data, weights, per_class[:CLASSES], per_class[CLASSES:])


def _writer(spark) -> Callable[[DataFrame, str], tuple[DataFrame, str]]:
    def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = work_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return reread(spark, path, df), path

    return write
