"""Repeated passages across documents, found with a logarithmic family of suffix indexes.

The contract is exact: a byte goes when a ``length``-byte string that covers it also starts
in a document with a smaller id. A full suffix array of every byte would be many times
the corpus, so the arrays are sparse: they hold the suffixes at anchors, the smallest of the
hashed ``SEED_BYTES``-byte seeds of each ``length``-byte window (leftmost among equals).
Equal windows have equal seeds at equal places, so no shared window is missed.

1. Documents come in batches by id. A batch's anchors, sorted by their seeds, are its array,
   cut into buckets of seeds. The array is merge-scanned with the arrays of earlier levels:
   seeds that two documents share are hits. The same scan makes the batch a level, merged
   with the levels of equal size, so there are log(batches) levels.
2. Only hits fetch text: each sends its seed and the bytes around it to the bucket of the
   seed. There, for each of the places a seed can have in a window, equal windows are
   grouped, and every window whose group has a smaller document is marked. A bucket that
   a very frequent seed has filled past ``HOT_ROWS`` is not one task: its windows are sent
   on by their own hashes, of equal ones in a task only the smallest document's.
3. Marked windows are united per document and cut out of its text.

Tasks reduce before each shuffle: a seed that two documents of a task share is sent once,
and of occurrences with equal surroundings only those of the smallest document are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import discard, id_and_text, release, reread, slices, stored
from labelloom.llm.hashing import Rolling, mix, row_hash, row_sums
from labelloom.sources.session import work_path

LENGTH = 50
SEED_BYTES = 20
BATCHES = 4
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64
# Occurrences carry the bytes around them, so their buckets are finer.
CONTEXT_BUCKET_BYTES = 8 << 20
LEAST_CONTEXT_BUCKETS = 128
# Occurrences that one task takes as a bucket, about 300 MB with the hashes of their windows.
HOT_ROWS = 1 << 19
SLICE = 2 << 20
CHUNK_ANCHORS = 1 << 20
CHUNK_HITS = 1 << 17
CHUNK_SPLIT = 1 << 15
# Stands for the documents of a seed that several are known to share; they are already among the hits.
SHARED = -(1 << 63)
NO_ID = (1 << 63) - 1

HIT, LEVEL = 1, 2
ENTRY = "kind int, bucket int, uid long, seeds binary, uids binary, counts binary"
_ENTRY = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("uid", pa.int64()), ("seeds", pa.binary()),
                    ("uids", pa.binary()), ("counts", pa.binary())])
CONTEXT = "bucket int, n long, block binary, uid long, starts binary"
_CONTEXT = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("block", pa.binary()), ("uid", pa.int64()),
                      ("starts", pa.binary())])
WINDOW = "h long, doc long, uid long, start long, starts binary"
_WINDOW = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("starts", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and the run of each value."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _doc_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and their edges."""
    texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), edges


def anchors(hashed: np.ndarray, edges: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> np.ndarray:
    """Places of the anchors in a buffer whose seeds have these hashes; windows stay within a document."""
    width = length - seed + 1
    low = np.uint64((1 << 32) - 1)
    least = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if len(least) > width - step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(len(least) + 1, np.int8)
    starts, stops = edges[:-1], edges[1:] - length + 1
    fits = stops > starts
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, stops[fits], -1)
    chosen = (least[np.cumsum(inside[:-1]) > 0] & low).astype(np.int64)
    return np.unique(chosen)


def _hit_rows(uids: np.ndarray, seeds: np.ndarray, bucket: int | np.ndarray) -> pa.RecordBatch:
    """One row for each document with the seeds it shares."""
    order = np.argsort(uids, kind="stable")
    uids, seeds = uids[order], seeds[order].astype("<u4")
    first, _ = _runs(uids)
    blobs = [p.tobytes() for p in np.split(seeds, first[1:])] if len(first) else []
    n = len(first)
    buckets = np.full(n, bucket) if np.isscalar(bucket) else np.arange(n) % bucket[0]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, HIT), pa.int32()), pa.array(buckets, pa.int32()), pa.array(uids[first], pa.int64()),
         pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_ENTRY,
    )


def _level_row(bucket: int, seeds: np.ndarray, uids: np.ndarray) -> list:
    """Array part of a bucket, kept document by document: ids once, with the number of their seeds."""
    order = np.argsort(uids, kind="stable")
    uids = uids[order]
    first, _ = _runs(uids)
    counts = np.diff(np.append(first, len(uids)))
    blobs = (seeds[order].astype("<u4"), uids[first].astype("<i8"), counts.astype("<u4"))
    return [LEVEL, bucket, None, *[x.tobytes() for x in blobs]]


def _shared(keys: np.ndarray, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by key: whether two documents share the key, and which entries stay in an array.

    Of a shared key one entry stays, as its mark.
    """
    first, run = _runs(keys)
    lone = np.ones(len(first), bool)
    np.logical_and.at(lone, run, (uids == uids[first][run]) & (uids != SHARED))
    shared = ~lone[run]
    stays = ~shared
    stays[first] = True
    return shared, stays


def _seed_key(hashed: np.ndarray) -> np.ndarray:
    """Another scrambling of seed hashes, as those of anchors are small ones; its low half names the seed."""
    return mix(hashed ^ np.uint64(0x5851F42D4C957F2D))


def batch_arrays(docs: DataFrame, buckets: int) -> DataFrame:
    """Array parts of the documents' anchors for each bucket, and hits within a task's documents."""

    def emit(seeds: np.ndarray, uids: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = ((seeds >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        keys = (bucket.astype(np.uint64) << np.uint64(32)) | (seeds & np.uint64(0xFFFFFFFF))
        order = np.argsort(keys, kind="stable")
        keys, uids, bucket = keys[order], uids[order], bucket[order]
        shared, stays = _shared(keys, uids)
        yield _hit_rows(uids[shared], keys[shared] & np.uint64(0xFFFFFFFF), np.array([buckets]))
        uids = np.where(shared, SHARED, uids)[stays]
        keys, bucket = keys[stays] & np.uint64(0xFFFFFFFF), bucket[stays]
        yield _entry_batch([_level_row(b, keys[part], uids[part]) for b, part in zip(*_parts(bucket), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, count = Rolling(), [], 0
        for b in slices(batches, limit=SLICE):
            data, edges = _doc_bytes(b)
            if len(data) < LENGTH:
                continue
            rolling.read(data)
            hashed = rolling.windows(SEED_BYTES)
            at = anchors(hashed, edges)
            doc = np.searchsorted(edges, at, side="right") - 1
            held.append((_seed_key(hashed[at]), b.column("uid").to_numpy()[doc]))
            count += len(at)
            if count >= CHUNK_ANCHORS:
                yield from emit(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("uid", "text").mapInArrow(run, ENTRY)


def _parts(sorted_groups: np.ndarray) -> tuple[list[int], list[slice]]:
    if not len(sorted_groups):
        return [], []
    first, _ = _runs(sorted_groups)
    stops = [*first[1:].tolist(), len(sorted_groups)]
    return sorted_groups[first].tolist(), [slice(a, b) for a, b in zip(first.tolist(), stops, strict=True)]


def _entry_batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY, strict=True)], schema=_ENTRY)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def _scan(keep: int | None):
    """Merge the arrays of one bucket: hits between them, and the array of the new level.

    Rows of earlier levels carry the level's size as their uid. Levels of at most ``keep``
    go into the new level with the batch; with None no level is made.
    """

    def run(t: pa.Table) -> pa.Table:
        hits = t.filter(pa.compute.equal(t.column("kind"), HIT))
        arrays = t.filter(pa.compute.equal(t.column("kind"), LEVEL))
        bucket = t.column("bucket")[0].as_py()
        out = [hits]
        if arrays.num_rows:
            sizes = np.array([len(x) // 4 for x in arrays.column("seeds").to_pylist()])
            level = np.repeat(arrays.column("uid").fill_null(-1).to_numpy(), sizes)
            seeds, counts = _joined(arrays.column("seeds"), "<u4"), _joined(arrays.column("counts"), "<u4")
            uids = np.repeat(_joined(arrays.column("uids"), "<i8"), counts)
            order = np.argsort(seeds, kind="stable")
            seeds, uids, level = seeds[order], uids[order], level[order]
            shared, _ = _shared(seeds, uids)
            found = shared & (uids != SHARED)
            out.append(pa.Table.from_batches([_hit_rows(uids[found], seeds[found], bucket)]))
            if keep is not None:
                mine = level <= keep
                uids, seeds, shared = np.where(shared, SHARED, uids)[mine], seeds[mine], shared[mine]
                first, _ = _runs(seeds)
                stays = ~shared
                stays[first] = True
                row = _level_row(bucket, seeds[stays], uids[stays])
                out.append(pa.Table.from_batches([_entry_batch([row])]))
        return pa.concat_tables([x.select(_ENTRY.names).cast(_ENTRY) for x in out])

    return run


class SuffixIndex:
    """Levels of sparse suffix arrays in the shared folder; ``add`` scans and takes in a batch."""

    def __init__(self, spark, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, str]] = []
        self.hits: list[str] = []

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{path}/kind={LEVEL}").withColumn("kind", F.lit(LEVEL))

    def _write(self, rows: DataFrame) -> str:
        path = work_path(self.spark, "suffix-level")
        rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        return path

    def _has(self, path: str, kind: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scan a batch against all levels; it becomes a level itself, with those of its size, unless it is the last."""
        rows = batch_arrays(docs, self.buckets)
        for size, path in self.levels:
            rows = rows.union(self._level(path).withColumn("uid", F.lit(size).cast("bigint")).select(rows.columns))
        size, merged = 0, []
        while self.levels and not last and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size += 1
        path = self._write(rows.groupBy("bucket").applyInArrow(_scan(None if last else size - 1), ENTRY))
        self.hits.append(path)
        if self._has(path, LEVEL):
            self.levels.append((size, path))
        discard(self.spark, *[f"{p}/kind={LEVEL}" for p in merged])
        release(self.spark)

    def shared_seeds(self) -> DataFrame:
        """uid and blobs of the seeds that a document shares with another one."""
        found = [p for p in self.hits if self._has(p, HIT)]
        rows = [self.spark.read.schema(ENTRY).parquet(f"{p}/kind={HIT}").select("uid", "seeds") for p in found]
        if not rows:
            return self.spark.createDataFrame([], "uid long, seeds array<binary>")
        every = rows[0]
        for r in rows[1:]:
            every = every.union(r)
        return every.groupBy("uid").agg(F.collect_list("seeds").alias("seeds"))

    def drop_levels(self) -> None:
        discard(self.spark, *[f"{path}/kind={LEVEL}" for _, path in self.levels])
        self.levels = []


_LEFT = LENGTH - SEED_BYTES
_SPAN = _LEFT + LENGTH
_OCCURRENCE = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("place", "<u4"), ("left", "u1"), ("right", "u1"),
                        ("bytes", "u1", (_SPAN,))])


def _united(uids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each document the sorted distinct starts of its marked windows."""
    order = np.lexsort((starts, uids))
    uids, starts = uids[order], starts[order].astype("<i8")
    for uid, part in zip(*_parts(uids), strict=True):
        mine = np.unique(starts[part])
        # of windows that follow each other byte by byte, keep what covers the same bytes
        keep = np.ones(len(mine), bool)
        if len(mine) > 2:
            keep[1:-1] = (mine[2:] - mine[:-2] > 2) | (np.arange(1, len(mine) - 1) % 16 == 0)
        yield uid, mine[keep].tobytes()


def _thinned(marks: np.ndarray) -> np.ndarray:
    """Marks by offset and row, without those that neighbours on both sides cover; one in 16 stays."""
    between = np.zeros_like(marks)
    between[1:-1] = marks[:-2] & marks[2:]
    between[::16] = False
    return marks & ~between


def _blocks(rows: np.ndarray, size: int = 1 << 14) -> Iterator[np.ndarray]:
    """Parts of a matrix, so that work on 64-bit copies of its bytes stays small; one empty part if it is empty."""
    for at in range(0, max(1, len(rows)), size):
        yield rows[at : at + size]


def _inside(rows: np.ndarray) -> np.ndarray:
    """For every row and offset, whether that window around the row's seed lies in its document."""
    offsets = np.arange(_LEFT + 1)
    return (offsets[None, :] <= rows["left"][:, None]) & (LENGTH - offsets[None, :] <= rows["right"][:, None])


def contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of occurrences for each bucket, and windows already marked within a task."""

    def occurrences(b: pa.RecordBatch, rolling: Rolling) -> np.ndarray:
        data, edges = _doc_bytes(b)
        if len(data) < LENGTH:
            return np.zeros(0, _OCCURRENCE)
        rolling.read(data)
        hashed = rolling.windows(SEED_BYTES)
        at = anchors(hashed, edges)
        doc = np.searchsorted(edges, at, side="right") - 1
        # the anchors of a document whose seed is among those it shares
        blobs = [b"".join(x) for x in b.column("seeds").to_pylist()]
        wanted = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs]).astype(np.uint64) << np.uint64(32)
        wanted |= np.frombuffer(b"".join(blobs), "<u4")
        mine = (doc.astype(np.uint64) << np.uint64(32)) | (_seed_key(hashed[at]) & np.uint64(0xFFFFFFFF))
        pick = np.isin(mine, wanted)
        at, doc = at[pick], doc[pick]
        rows = np.zeros(len(at), _OCCURRENCE)
        rows["seed"] = rolling.spans(at, at + SEED_BYTES)
        rows["doc"] = b.column("doc").to_numpy()[doc]
        rows["uid"] = b.column("uid").to_numpy()[doc]
        rows["place"] = at - edges[doc]
        rows["left"] = np.minimum(_LEFT, at - edges[doc])
        rows["right"] = np.minimum(LENGTH, edges[doc + 1] - at)
        offsets = np.arange(-_LEFT, LENGTH)
        inside = (offsets >= -rows["left"][:, None].astype(np.int64)) & (offsets < rows["right"][:, None])
        rows["bytes"] = np.where(inside, data[np.clip(at[:, None] + offsets, 0, len(data) - 1)], 0)
        return rows

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate([row_hash(row_sums(part), 0, _SPAN) for part in _blocks(rows["bytes"])])
        same = mix(whole ^ (rows["left"].astype(np.uint64) << np.uint64(8)) ^ rows["right"])
        order = np.lexsort((rows["doc"], same))
        rows, same = rows[order], same[order]
        head, run = _runs(same)
        later = rows["doc"] > rows["doc"][head][run]
        marked = rows[later]
        offset, which = np.nonzero(_thinned(_inside(marked).T))
        out = [(None, None, None, uid, blob) for uid, blob in _united(marked["uid"][which], marked["place"][which].astype(np.int64) - offset)]
        rows = rows[~later]
        bucket = (mix(rows["seed"]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rows["doc"], rows["seed"], bucket))
        rows, bucket = rows[order], bucket[order]
        for number, part in zip(*_parts(bucket), strict=True):
            out.append((number, part.stop - part.start, pa.compress(rows[part].tobytes(), "zstd", asbytes=True), None, None))
        cols = list(zip(*out, strict=True)) or [()] * len(_CONTEXT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT, strict=True)], schema=_CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, count = Rolling(), [], 0
        for b in slices(batches, limit=SLICE // 4):
            held.append(occurrences(b, rolling))
            count += len(held[-1])
            if count >= CHUNK_HITS:
                yield from emit(np.concatenate(held))
                held, count = [], 0
        if count:
            yield from emit(np.concatenate(held))

    return docs.mapInArrow(run, CONTEXT)


def _opened(t: pa.Table | pa.RecordBatch) -> Iterator[np.ndarray]:
    """The occurrences of each block."""
    for block, n in zip(t.column("block"), t.column("n").to_pylist(), strict=True):
        data = pa.decompress(block.as_buffer(), n * _OCCURRENCE.itemsize, "zstd", asbytes=True)
        yield np.frombuffer(data, _OCCURRENCE)


def _window_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of the window that starts ``offset`` bytes before the seed, for each offset and row."""
    hashes = np.empty((_LEFT + 1, len(rows)), np.uint64)
    at = 0
    for part in _blocks(rows["bytes"]):
        sums = row_sums(part)
        for offset in range(_LEFT + 1):
            hashes[offset, at : at + len(part)] = row_hash(sums, _LEFT - offset, _LEFT - offset + LENGTH)
        at += len(part)
    return hashes


def marked_windows(t: pa.Table) -> pa.Table:
    """Windows of one bucket that also start in a document with a smaller id."""
    rows = np.concatenate(list(_opened(t)))
    seeds = np.ascontiguousarray(rows["seed"])
    order = np.argsort(seeds)
    _, run = _runs(seeds[order])
    rows = rows[np.sort(order[np.bincount(run)[run] > 1])]
    hashes, docs = _window_hashes(rows), np.ascontiguousarray(rows["doc"])
    marks = np.zeros((_LEFT + 1, len(rows)), bool)
    for offset in range(_LEFT + 1):
        fits = np.flatnonzero((offset <= rows["left"]) & (LENGTH - offset <= rows["right"]))
        hashed = hashes[offset, fits]
        order = np.argsort(hashed)
        head, run = _runs(hashed[order])
        mine = docs[fits[order]]
        least = np.minimum.reduceat(mine, head) if len(head) else mine
        marks[offset, fits[order]] = mine > least[run]
    offset, which = np.nonzero(_thinned(marks))
    out = list(_united(rows["uid"][which], rows["place"][which].astype(np.int64) - offset))
    return pa.table({"uid": pa.array([x[0] for x in out], pa.int64()), "starts": pa.array([x[1] for x in out], pa.binary())})


def split_windows(blocks: DataFrame, path: str) -> DataFrame:
    """Windows of buckets too large for one task that also start in a document with a smaller id.

    The folder ``path`` holds them until the result is written. Tasks take some blocks at a time. Of the windows with one hash there, those of the
    smallest document go on under their hash; the others are marked. A window's smallest
    document is a partial aggregate, and the join with it is split where a hash is hot.
    """
    spark = blocks.sparkSession

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = _window_hashes(rows)
        which, offset = np.nonzero(_inside(rows))
        # the place of the seed in the window belongs to the key, as within a bucket
        h = mix(hashes[offset, which] + offset.astype(np.uint64))
        order = np.lexsort((rows["doc"][which], h))
        h, doc, uid = h[order], rows["doc"][which[order]], rows["uid"][which[order]]
        start = rows["place"][which[order]].astype(np.int64) - offset[order]
        head, run = _runs(h)
        later = doc > doc[head][run]
        marked = list(_united(uid[later], start[later]))
        n, stays = len(marked), ~later
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[0] for x in marked], pa.int64()),
             pa.nulls(n, pa.int64()), pa.array([x[1] for x in marked], pa.binary())], schema=_WINDOW
        )
        mine = [pa.array(x[stays]) for x in (h.view(np.int64), doc, uid, start)]
        heads = pa.RecordBatch.from_arrays([*mine, pa.nulls(int(stays.sum()), pa.binary())], schema=_WINDOW)
        yield from (heads.slice(at, 1 << 16) for at in range(0, heads.num_rows, 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            for rows in (part for block in _opened(b) for part in _blocks(block, CHUNK_SPLIT)):
                held.append(rows)
                count += len(rows)
                if count >= CHUNK_SPLIT:
                    yield from emit(np.concatenate(held))
                    held, count = [], 0
        if count:
            yield from emit(np.concatenate(held))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(_united(b.column("uid").to_numpy(), b.column("start").to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["uid", "starts"]
            )

    found = blocks.select("n", "block").mapInArrow(run, WINDOW)
    found.write.option("compression", "zstd").parquet(path)
    found = reread(spark, path, found)
    heads = found.filter("h is not null").select("h", "doc", "uid", "start")
    least = heads.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    later = heads.join(least.select("h", "least"), "h").filter("doc > least").select("uid", "start")
    kind = "uid long, starts binary"
    return found.filter("h is null").select("uid", "starts").union(later.mapInArrow(united, kind))


def spans_of(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows with these starts cover."""
    if not blobs:
        return []
    starts = np.unique(np.frombuffer(b"".join(blobs), "<i8"))
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + LENGTH
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(starts) - 1)
    return list(zip(starts[first].tolist(), (starts[last] + LENGTH).tolist(), strict=True))


def repeated_windows(docs: DataFrame, batches: int = BATCHES, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The documents with a key ``uid``, and for each uid the starts of its marked windows."""
    spark = docs.sparkSession
    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("uid", F.xxhash64("doc", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    edges = sorted(set(docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    index = SuffixIndex(spark, buckets)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        last = high is None
        part = keyed
        if low is not None:
            part = part.filter(F.col("doc") > F.lit(int(low)))
        if high is not None:
            part = part.filter(F.col("doc") <= F.lit(int(high)))
        index.add(part, last)
    index.drop_levels()
    buckets = max(LEAST_CONTEXT_BUCKETS, size // CONTEXT_BUCKET_BYTES)
    near = contexts(keyed.join(index.shared_seeds(), "uid").select("uid", "doc", "text", "seeds"), buckets)
    path = work_path(spark, "suffix-contexts")
    near.write.option("compression", "zstd").parquet(path)
    near = reread(spark, path, near)
    release(spark)
    blocks = near.filter("bucket is not null").select("bucket", "n", "block")
    sizes = blocks.groupBy("bucket").agg(F.sum("n").alias("rows"))
    hot = stored(sizes.filter(F.col("rows") > hot_rows).select("bucket"), "suffix-hot-buckets")
    crossed = blocks.join(hot, "bucket", "left_anti").groupBy("bucket").applyInArrow(marked_windows, "uid long, starts binary")
    found, hot_path = near.filter("bucket is null").select("uid", "starts").union(crossed), []
    if not hot.isEmpty():
        hot_path = [work_path(spark, "suffix-hot")]
        found = found.union(split_windows(blocks.join(hot, "bucket", "left_semi"), hot_path[0]))
    out = work_path(spark, "suffix-windows")
    found.write.parquet(out)
    discard(spark, path, *hot_path)
    release(spark)
    return keyed, reread(spark, out, crossed)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes left) and spans of every row.

    Null texts are empty. Rows with equal ids don't count as earlier than each other; rows
    without an id come after all others. Texts below ``LENGTH`` bytes lose nothing.
    """
    keyed, windows = repeated_windows(id_and_text(docs, id_col, text_col), batches, hot_rows)
    marks = windows.groupBy("uid").agg(F.collect_list("starts").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, blobs in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                data, spans = text.encode("utf-8", "surrogatepass"), spans_of(blobs)
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join([data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept,
                            [{"start": s, "stop": e} for s, e in spans]))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names
            )

    rows = keyed.join(marks, "uid", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(run, f"{RESULT}, kept binary, spans array<struct<start:long, stop:long>>")
