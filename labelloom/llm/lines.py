"""Line dedup with DataFrame functions only: lines that many documents hold stay in one of them.

1. Texts are exploded to lines. Lines of ``min_chars`` code points or more, stripped of ASCII
   white space at both ends and with A-Z in lower case, become 128-bit hashes.
2. Per hash the distinct documents are counted; Spark first reduces to distinct (hash, id)
   pairs, which no single line can crowd, and then to partial counts, so a line that a third
   of all documents hold is no hot spot. Few hashes reach ``min_docs``.
3. Lines look their hash up. Hashes with more than 1 / ``HOT_SHARE`` of the occurrences of
   all frequent lines, so at most ``HOT_SHARE`` of them, are broadcast; the others are joined by hash.
4. A document's dropped places go back to its text, and what is left is joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import LETTERS, stored

WHITE = " \t\n\x0b\f\r"
MIN_CHARS = 40
MIN_DOCS = 5
# At most this many hashes of 40 bytes are broadcast.
HOT_SHARE = 10_000


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _identity(id_col: str, text_col: str) -> list[Column]:
    """What tells a row from others: rows alike in both lose the same lines."""
    return [_name(id_col).alias("id"), F.xxhash64(_whole(_name(text_col))).alias("text_hash")]


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, text_hash, place in the text from 0, and hash of the key of each long line."""
    key = F.trim(F.col("line"), F.lit(WHITE))
    # a projection of its own below the explode, or the text would be hashed again for each line
    texts = docs.select(*_identity(id_col, text_col), F.split(_whole(_name(text_col)), "\n").alias("lines"))
    return (
        texts.select("id", "text_hash", F.posexplode("lines").alias("place", "line"))
        .withColumn("key", key)
        .filter(F.length("key") >= min_chars)
        .select("id", "text_hash", "place", F.unhex(F.md5(F.translate("key", *LETTERS))).alias("hash"))
    )


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """hash, held (lines with it) and last_id of the hashes that ``min_docs`` documents hold."""
    documents = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return (
        lines.groupBy("hash")
        .agg(documents.alias("documents"), F.count(F.lit(1)).alias("held"), F.max("id").alias("last_id"))
        .filter(F.col("documents") >= min_docs)
        .drop("documents")
    )


def dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """id, text_hash and ``gone``, the places of the lines that go."""
    total = frequent.agg(F.sum("held")).first()[0] or 0
    is_hot = F.col("held") * HOT_SHARE > total
    hot = F.broadcast(frequent.filter(is_hot).drop("held"))
    rest = frequent.filter(~is_hot).drop("held")
    found = lines.join(hot, "hash").unionByName(
        lines.join(hot, "hash", "left_anti").join(rest, "hash")
    )
    gone = found.filter(~F.col("id").eqNullSafe(F.col("last_id")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("place").alias("gone"))


def without_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Each input row as struct ``row`` with its text cut, n_lines (before) and n_dropped.

    Texts are split at line feeds; a null or empty text is one empty line and stays as it is.
    Lines whose key is held by ``min_docs`` documents go, but for the largest id that holds
    it: there all of them stay, however often they repeat. Rows that repeat an id are one
    document, and so are all rows without an id, which come before any id. Two keys count as
    equal when their 128-bit hashes are. An empty table gives an empty one; the struct keeps
    all columns of the input, whatever their names. A document's lines are held by one task.
    """
    lines = stored(long_lines(docs, id_col, text_col, min_chars), "long-lines")
    gone = dropped_places(lines, stored(frequent_lines(lines, min_docs), "frequent-lines"))
    parts = [
        F.split(_name(c), "\n").alias(c) if c == text_col else _name(c).alias(c) for c in docs.columns
    ]
    rows = docs.select(F.struct(*parts).alias("row"), *_identity(id_col, text_col)).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    text = F.col("row").getField(text_col)
    n_lines = F.when(text.isNull(), 1).otherwise(F.size(text))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.transform(kept, lambda p: F.get(text, p)))
    return rows.join(gone.alias("g"), same, "left").select(
        F.col("row").withField(text_col, F.array_join(left, "\n")).alias("row"),
        n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"),
    )


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """All rows with the columns of the input, without the lines that go."""
    return without_frequent_lines(docs, id_col, text_col, **bounds).select("row.*")
