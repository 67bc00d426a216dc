"""MinHash near-dedup with an LSH forest.

Every text is a set of word shingles. Equal sets are one class. A forest of sorted orders
stands over the classes' MinHash signatures: each tree sorts them by its own sequence of
minima, and neighbours with a common prefix of at least ``MIN_DEPTH`` minima are
candidates. How deep a region is compared follows its size: in a small region (rows that
share a prefix) all rows are neighbours, a larger one is split by one more minimum at a time
until its parts are small, and besides every row meets the ``NEAR`` next ones of the order.
A range sort cuts a hot region into even tasks.

Candidates are confirmed on the full sets. A first group of trees finds most links; pairs
of the others are confirmed only where they would join two components. Rows of regions
that were too large for all to meet then go through an exact join of their prefixes
(``crossing_pairs``), so a crowd hides no link. Classes with the same component form the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import LOWER, id_and_text, release, slices, stored
from labelloom.llm.hashing import Rolling, mix, word_spans

WORDS = 5
HASHES = 64
TREES = 24
FIRST_TREES = 4
DEPTH = 8
MIN_DEPTH = 3
REGION = 8
NEAR = 2
# A pair counts as linked when 100 * common >= PERCENT * union.
PERCENT = 75
SEED = 7
# Bytes of text whose word hashes a task holds at once; they take many times the text.
SLICE = 2 << 20
# Shingles are ordered by counts in 2**COUNT_BITS cells, which the driver holds; any order gives the same links.
COUNT_BITS = 20
COUNT_BLOCK = 1 << 14

SETS = "doc_id long, text_hash long, n_shingles long, set_key string, signature binary"
TREE_ROW = "tree int, key binary, node long, size long"
PREFIX = "shingle long, node long, size long, left long, tail long"


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted.

    A text of fewer words is one shingle of them all; a text without words is empty.
    """
    buffer = b"\n".join([t.encode("utf-8", "surrogatepass") for t in texts]).translate(LOWER)
    data = np.frombuffer(buffer, np.uint8)
    rolling = Rolling()
    rolling.read(data)
    starts, stops = word_spans(data)
    hashed = rolling.spans(starts, stops)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    factor = np.uint64(0xD6E8FEB86659FD93)
    joined = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for i in range(words):
        joined = joined * factor + hashed[i : i + len(joined)]
    joined = mix(joined)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            one = np.uint64(xxhash.xxh64_intdigest(hashed[a:b].tobytes(), seed=b - a))
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signature(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), (1 << 32) - 1, np.uint64)
    for at in range(0, len(values), 2048):
        hashed = (values[at : at + 2048] * factors[:, None] + shifts[:, None]) >> np.uint64(32)
        best = np.minimum(best, hashed.min(axis=1))
    return best.astype(">u4")


def class_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null without shingles), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _functions(HASHES)
        for b in slices(batches, limit=SLICE):
            sets = shingle_sets(b.column("text").to_pylist())
            keys = [set_key(s) for s in sets]
            signs = [signature(s, factors, shifts).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.string()), pa.array(signs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_key", "signature"],
            )

    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SETS)


def tree_rows(classes: DataFrame, first: int, last: int) -> DataFrame:
    """A row of each class for the trees ``first`` to ``last - 1``: its minima in the tree's order."""
    rng = np.random.default_rng(SEED + 1)
    orders = np.stack([rng.permutation(HASHES)[:DEPTH] for _ in range(last)])[first:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, trees = b.num_rows, len(orders)
            minima = np.frombuffer(b"".join(b.column("signature").to_pylist()), ">u4").reshape(n, HASHES)
            keys = np.ascontiguousarray(minima[:, orders.ravel()].reshape(n * trees, DEPTH))
            ends = np.arange(n * trees + 1, dtype=np.int32) * (4 * DEPTH)
            key = pa.Array.from_buffers(pa.binary(), n * trees, [None, pa.py_buffer(ends), pa.py_buffer(keys)])
            repeat = lambda c: np.repeat(b.column(c).to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(first, last, dtype=np.int32), n)), key,
                 pa.array(repeat("node"), pa.int64()), pa.array(repeat("size"), pa.int64())],
                ["tree", "key", "node", "size"],
            )

    return classes.select("node", "size", "signature").mapInArrow(run, TREE_ROW)


def _neighbours(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller node first) among rows in tree order."""
    words = keys.view(">u4")
    prefix = np.logical_and.accumulate(words[1:] == words[:-1], axis=1) & (tree[1:] == tree[:-1])[:, None]
    depths = []
    for depth in range(MIN_DEPTH, DEPTH + 1) if len(node) else ():
        region = np.concatenate([[0], np.cumsum(~prefix[:, depth - 1])])
        depths.append((region, np.bincount(region)[region] <= REGION))
    left, right = [], []
    for lag in range(1, REGION):
        meets = np.zeros(max(0, len(node) - lag), bool)
        for at, (region, small) in enumerate(depths):
            together = region[lag:] == region[:-lag]
            meets |= together if lag <= NEAR and not at else together & small[lag:]
        pick = np.flatnonzero(meets)
        a, b = node[pick], node[pick + lag]
        low, high = np.minimum(size[pick], size[pick + lag]), np.maximum(size[pick], size[pick + lag])
        fits = (100 * low >= PERCENT * high) & (a != b)
        left.append(np.minimum(a, b)[fits])
        right.append(np.maximum(a, b)[fits])
    return np.concatenate(left), np.concatenate(right)


def _crowded(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows, in tree order, of regions too large for all rows to meet, or that may go on in another task."""
    words = keys.view(">u4")
    new = (words[1:, :MIN_DEPTH] != words[:-1, :MIN_DEPTH]).any(axis=1) | (tree[1:] != tree[:-1])
    region = np.concatenate([[0], np.cumsum(new)])
    return (np.bincount(region)[region] > REGION) | (region == 0) | (region == region[-1])


def _arrays(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    keys = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)
    return (t.column("tree").to_numpy(), keys, t.column("node").to_numpy(), t.column("size").to_numpy())


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs a < b of sorted tree neighbours, and the nodes of crowded regions.

    Each task scans one range of the order. The rows at its ends are handed on, so that
    neighbours in two ranges meet too.
    """
    edge = "a long, b long, border int, at int, tree int, key binary, node long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        tree, keys, node, size = _arrays(t)
        a, b = _neighbours(tree, keys, node, size)
        crowd = np.unique(node[_crowded(tree, keys)])
        none = lambda n, kind: pa.nulls(n, kind)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int32()), ("at", pa.int32()),
                            ("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64()), ("size", pa.int64())])
        n = len(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), *[none(n, schema.field(i).type) for i in range(2, 8)]], schema=schema
        )
        n = len(crowd)
        yield pa.RecordBatch.from_arrays(
            [pa.array(crowd), *[none(n, schema.field(i).type) for i in range(1, 8)]], schema=schema
        )
        place, ends = TaskContext.get().partitionId(), min(t.num_rows, REGION - 1)
        for border, part, shift in ((place, t.slice(0, ends), ends), (place + 1, t.slice(t.num_rows - ends), 0)):
            at = np.arange(ends, dtype=np.int32) + (REGION if shift else 0)
            yield pa.RecordBatch.from_arrays(
                [none(ends, pa.int64()), none(ends, pa.int64()), pa.array(np.full(ends, border, np.int32)), pa.array(at),
                 *[part.column(c).combine_chunks() for c in ("tree", "key", "node", "size")]], schema=schema,
            )

    def across(t: pa.Table) -> pa.Table:
        a, b = _neighbours(*_arrays(t.sort_by("at")))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = stored(ordered.mapInArrow(run, edge), "forest-pairs")
    inside = found.filter("border is null and b is not null").select("a", "b")
    crowd = found.filter("border is null and b is null").select(F.col("a").alias("node"))
    between = found.filter("border is not null").groupBy("border").applyInArrow(across, "a long, b long")
    return inside.union(between).distinct(), crowd.distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    """The distinct nodes that stand in a pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def sets_of_nodes(
    docs: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """node and its sorted shingles for every class among the distinct nodes.

    The text is that of a row with the class's smallest id; of the rows with that id those of
    other sets are passed over, and of rows that are alike one is taken.
    """
    wanted = classes.join(nodes.select("node"), "node", "left_semi").select(
        "node", F.col("least_id").alias("doc_id"), F.col("set_key").alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            sets = shingle_sets(b.column("text").to_pylist())
            own = [set_key(s) == w for s, w in zip(sets, b.column("wanted").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]
            ).filter(pa.array(own, pa.bool_()))

    rows = id_and_text(docs, id_col, text_col).join(wanted, "doc_id").select("node", "text", "wanted")
    return rows.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each cell."""
    blocks = (1 << COUNT_BITS) // COUNT_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            values = np.frombuffer(b"".join(b.column("shingles").to_pylist()), np.uint64)
            counts += np.bincount(_cells(values), minlength=len(counts))
        parts = [(k, part.tobytes()) for k, part in enumerate(counts.reshape(blocks, -1)) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"]
        )

    kind = "block int, counts binary"
    out = np.zeros((blocks, COUNT_BLOCK), np.int64)
    for r in sets.select("shingles").mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """The first shingles of each set in the order of counts, so many that linked sets have one in common.

    ``left`` is the number of shingles from this one on, ``tail`` a hash of them all.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, cols = b.slice(at, 512), []
                for node, x in zip(part.column("node").to_pylist(), part.column("shingles").to_pylist(), strict=True):
                    x = np.frombuffer(x, np.uint64)
                    x = x[np.lexsort((x, counts[_cells(x)]))]
                    n = len(x)
                    take = min(n, n + 1 - (PERCENT * n + 99) // 100)
                    tails = np.cumsum(mix(x)[::-1], dtype=np.uint64)[::-1]
                    cols.append((x[:take].view(np.int64), np.full(take, node), np.full(take, n),
                                 n - np.arange(take), tails[:take].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in zip(*cols, strict=True)],
                    ["shingle", "node", "size", "left", "tail"],
                )

    return sets.mapInArrow(run, PREFIX)


def crossing_pairs(rows: DataFrame) -> DataFrame:
    """From prefixes with the root of each node: pairs whose links join all components that any links join.

    The first common shingle of a linked pair is in both prefixes, and all they have in
    common is in their tails from there. Of the sets with one tail the smallest stands for
    the others: if x and y are linked there, so are x with the one that stands for y, y
    with the one for x, and those two with each other. So rows meet only these. Of a shingle's
    commonest component, rows meet only the ones of other components.
    """
    per_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    shared = per_root.groupBy("shingle").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")
    ).filter("roots > 1").select("shingle", "main")
    rows = stored(rows.join(shared, "shingle").select("*", (F.col("root") != F.col("main")).alias("other")), "prefixes")
    heads = rows.groupBy("shingle", "left", "tail").agg(F.min(F.struct("size", "node", "root", "other")).alias("h")).select(
        "shingle", F.col("left").alias("left_h"), F.col("h.size").alias("size_h"), F.col("h.node").alias("node_h"),
        F.col("h.root").alias("root_h"), F.col("h.other").alias("other_h"),
    )
    # overlap >= PERCENT % of the union, at most the shorter tail in common
    fits = f"root <> root_h and {100 + PERCENT} * least(left, left_h) >= {PERCENT} * (size + size_h)"
    ends = [F.least("node", "node_h").alias("a"), F.greatest("node", "node_h").alias("b")]
    few = rows.filter("other").join(heads, "shingle").filter(fits).select(*ends)
    many = rows.filter("not other").join(heads.filter("other_h"), "shingle").filter(fits).select(*ends)
    return few.union(many).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable over the links a, b.

    Each round takes the smallest root among the neighbours and then jumps to the root's
    own root, so rounds grow with the logarithm of a component's diameter.
    """
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        met = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("met"))
        own = roots.select(F.col("node").alias("met"), F.col("root").alias("beyond"))
        jumped = stored(
            met.join(own, "met").select("node", F.col("root").alias("old"), F.least("met", "beyond").alias("root")), "roots"
        )
        moved = jumped.filter("root <> old").limit(1).count()
        roots = jumped.select("node", "root")
        if not moved:
            return roots


def row_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id for each row."""
    spark = docs.sparkSession
    rows = stored(class_rows(docs, id_col, text_col), "shingle-classes")
    usable = rows.filter("set_key is not null and doc_id is not null")
    # one row per distinct set; equal sets are reduced in each task before the shuffle
    least = F.min(F.struct("doc_id", "n_shingles", "signature"))
    classes = stored(
        usable.groupBy("set_key").agg(least.alias("c")).select(
            "set_key", F.col("c.doc_id").alias("least_id"), F.col("c.n_shingles").alias("size"), "c.signature",
            # a number of its own, fixed by being written: an id may have rows of several sets
            F.monotonically_increasing_id().alias("node"),
        ), "classes",
    )
    sets_for = lambda nodes: sets_of_nodes(docs, nodes, classes.drop("signature"), id_col, text_col)
    pairs, crowd = candidates(tree_rows(classes, 0, FIRST_TREES))
    first = stored(pairs, "pairs")
    links = stored(confirm(first, sets_for(ends_of(first))), "links")
    roots = components(links)
    release(spark)
    rest, more_crowd = candidates(tree_rows(classes, FIRST_TREES, TREES))
    rest = rest.join(first, ["a", "b"], "left_anti")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = (
        rest.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    )
    apart = stored(apart, "pairs")
    more = stored(confirm(apart, sets_for(ends_of(apart))), "links")
    release(spark)
    # the first components, as links to their roots, joined by the links that were still missing
    rooted = lambda: roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(rooted().union(more))
    # rows of crowded regions, exactly
    crowd = crowd.union(more_crowd).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    crowd = stored(crowd, "crowd")
    sets = stored(sets_for(crowd), "sets")
    crossing = stored(crossing_pairs(prefixes(sets, shingle_counts(sets)).join(crowd, "node")), "pairs")
    roots = components(rooted().union(stored(confirm(crossing, sets), "links")))
    release(spark)
    rooted_classes = classes.select("set_key", "least_id", "node").join(roots, "node", "left").select(
        "set_key", "least_id", F.coalesce("root", "node").alias("root")
    )
    least_of = rooted_classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted_classes.join(least_of, "root").select("set_key", "component_id")
    marked = rows.drop("signature").join(named, "set_key", "left")
    alone = F.col("set_key").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Null texts are empty; empty sets are linked with nothing and stay. Rows that repeat an id
    each have the component of their own text. Rows without an id are linked with nothing and
    stay, with a null component. Words are maximal runs without ASCII white space, A-Z lowered.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return row_groups(docs, id_col, text_col).drop("text_hash").withColumn("kept", kept)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id; columns of the input.

    Each row is decided by its own id and text, so of rows that repeat an id only those go
    whose text has a near copy under a smaller id. Rows that repeat id and text stay or go
    together. Empty texts and rows without an id stay; an empty table gives an empty one.
    """
    groups = row_groups(docs, id_col, text_col).filter("not doc_id <=> component_id")
    gone = groups.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (text_hash == gone["_gone_text"]), "left_anti")
