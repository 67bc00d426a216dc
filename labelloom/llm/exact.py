"""Exact dedup: an extendible-hash index on shared files, DataFrame functions only.

1. Equal texts meet in one aggregate on (hash, text): Spark reduces them before the
   shuffle, and the text in the key compares bytes. It leaves one small entry per text.
2. The directory starts at the depth that the number of entries asks for and doubles
   while a bucket holds more than ``capacity`` entries; each bucket keeps the smallest
   depth at which it fits, so only overfull buckets are split.
3. Owner tasks take key ranges of the buckets. Entries of one bucket whose hashes collide
   become one chain; the chains are written to the shared folder.
4. Documents find their entry through the index alone: the leading bits of their hash name
   a slot of the directory, the slot a bucket, and in it the chain of the hash is searched
   for the entry with the same 256-bit digest of the text. The look-up is a shuffled join,
   so adaptive execution splits the range of a text with very many copies.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import SPACES, stored

BUCKET_ENTRIES = 1_000_000
# A directory of at most 2^16 slots of a few bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_DEPTH = 16
# Entries that share this many leading bits stay in one bucket as a chain.
MAX_DEPTH = 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _slot(depth: int) -> Column:
    """Leading bits of the hash; slot 0 at depth 0."""
    return F.shiftrightunsigned(F.col("h"), 64 - depth) if depth else F.pmod(F.col("h"), F.lit(1).cast("bigint"))


def _hashed(text: str, hash_bits: int) -> Column:
    """The leading bits of the text's hash; fewer than 64 only to make chains longer."""
    return F.xxhash64(text).bitwiseAND(F.lit((-1 << (64 - hash_bits)))).alias("h")


def text_entries(docs: DataFrame, id_col: str, text_col: str, hash_bits: int = 64) -> DataFrame:
    """One row per distinct normalised text: h, digest, keep_id, group_size."""
    keyed = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    return (
        keyed.groupBy(_hashed("t", hash_bits), "t")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("t", 256).alias("digest"), "keep_id", "group_size")
    )


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Slots of the final directory with the local depth of their bucket, and the global depth."""
    total = entries.count()
    depth = max(0, (max(total, 1) - 1) // capacity).bit_length()
    while True:
        fill = entries.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        if depth >= MAX_DEPTH or (fill.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1
    depths = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")
    prefix = F.expr(f"shiftright(slot, {depth} - local_depth)")
    nested = fill.select("slot", "n", depths).withColumn("prefix", prefix)
    fits = nested.groupBy("local_depth", "prefix").agg(F.sum("n").alias("held")).filter(
        (F.col("held") <= capacity) | (F.col("local_depth") == depth)
    )
    slots = nested.join(fits, ["local_depth", "prefix"]).groupBy("slot").agg(F.min("local_depth").alias("local_depth"))
    return slots, depth


class Index(NamedTuple):
    """Chains by bucket, and the directory that leads to the buckets."""

    chains: DataFrame  # local_depth, bucket, h, chain: array of (digest, keep_id, group_size)
    slots: DataFrame  # slot, local_depth
    depth: int
    hash_bits: int


def _bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket that the directory names for their hash."""
    slots = F.broadcast(slots) if depth <= BROADCAST_DEPTH else slots
    found = rows.withColumn("slot", _slot(depth)).join(slots, "slot", "left")
    return found.withColumn("bucket", F.expr(f"shiftright(slot, {depth} - local_depth)")).drop("slot")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, hash_bits: int = 64
) -> Index:
    """Index of all distinct texts in the shared folder."""
    entries = stored(text_entries(docs, id_col, text_col, hash_bits), "exact-entries")
    slots, depth = directory(entries, capacity)
    slots = stored(slots, "exact-directory")
    chain = F.sort_array(F.collect_list(F.struct("digest", "keep_id", "group_size"))).alias("chain")
    chains = (
        _bucket(entries, slots, depth)
        .repartitionByRange("bucket", "local_depth", "h")
        .groupBy("bucket", "local_depth", "h").agg(chain)
    )
    return Index(stored(chains, "exact-index"), slots, depth, hash_bits)


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """Rows with columns h and digest, and ``entry``, the one of their text, null where the index has none."""
    placed = _bucket(rows, index.slots, index.depth)
    entry = F.get(F.filter("chain", lambda e: e["digest"] == F.col("digest")), F.lit(0))
    found = placed.join(index.chains, ["bucket", "local_depth", "h"], "left")
    return found.withColumn("entry", entry).drop("bucket", "local_depth", "chain")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES,
    hash_bits: int = 64, index: Index | None = None,
) -> DataFrame:
    """Each input row as struct ``row`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space is one space. Null
    texts are empty texts, and those form a group like any other. The smallest id of a
    group stays; rows that repeat an id share its decision. A null id is never the one
    that stays unless its group has no other. The struct keeps all columns of the input,
    whatever their names. With an ``index`` of other rows, those decide: a text that it
    doesn't hold has null keep_id and group_size and stays.
    """
    index = index or build_index(docs, id_col, text_col, capacity, hash_bits)
    clean = normalised(docs[text_col])
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), clean.alias("t")).select(
        "row", "id", _hashed("t", index.hash_bits), F.sha2("t", 256).alias("digest")
    )
    return look_up(rows, index).select(
        "row",
        F.col("entry.keep_id").alias("keep_id"),
        F.col("entry.group_size").alias("group_size"),
        (F.col("entry").isNull() | F.col("id").eqNullSafe(F.col("entry.keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return exact_groups(docs, id_col, text_col).filter("kept").select("row.*")
