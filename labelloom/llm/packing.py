"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

A piece goes where the sum over residual gaps of the squared number of open sequences
with that gap becomes smallest; ties take the smallest gap. A packer's state is one
counter for each gap, whatever the number of pieces. Pieces are dealt at random into
groups of about ``GROUP_PIECES``, each packed by a task of its own, longest pieces first.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import id_and_text, slices, stored
from labelloom.llm.wordbpe import byte_symbols

LENGTH = 2048
END_ID = 0
GROUP_PIECES = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# The split pattern of byte-level tokenizer files, and the last character of Latin Extended-B.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_END = "\u024f"


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file.

    Where the file's ids follow its merges, texts of characters up to ``PLAIN_END`` that
    name no special token go through the faster rank encoder, which gives the same ids.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        order = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = None
        if order == sorted(order):
            place = {c: b for b, c in enumerate(byte_symbols())}
            plain = {bytes(place[c] for c in t): i for t, i in vocab.items() if all(c in place for c in t)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.ranks and (text.isascii() or max(text) <= PLAIN_END) and not any(t in text for t in self.special):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut at ``length``.

    Only documents beyond ``length`` are cut; their first piece takes what is left over.
    An empty or null text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                first = n % length or min(n, length)
                edges = [0, *range(first, n + 1, length)]
                for i in range(len(edges) - 1):
                    part = ids[4 * edges[i] : 4 * edges[i + 1]]
                    rows.append((doc, i, edges[i], len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class SumOfSquares:
    """Packs sizes one after another; ``put`` gives the sequence and the place in it."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.open = np.zeros(length + 1, np.int64)
        # twice the change of the sum when a sequence gets or loses a gap; gap 0 is closed and counts nothing
        self.gain = np.ones(length + 1, np.int64)
        self.gain[0] = 0
        self.lose = np.full(length + 1, 1 << 40, np.int64)
        self.lose[length] = 0
        self.with_gap: list[list[int]] = [[] for _ in range(length + 1)]
        self.made = 0

    def _count(self, gap: int, by: int) -> None:
        if 0 < gap < self.length:
            n = self.open[gap] = self.open[gap] + by
            self.gain[gap] = 2 * n + 1
            self.lose[gap] = 1 - 2 * n if n else 1 << 40

    def put(self, size: int) -> tuple[int, int]:
        gap = size + int(np.argmin(self.lose[size:] + self.gain[: self.length - size + 1]))
        if gap == self.length:
            at, self.made = self.made, self.made + 1
        else:
            at = self.with_gap[gap].pop()
        self._count(gap, -1)
        left = gap - size
        self._count(left, 1)
        if left:
            self.with_gap[left].append(at)
        return at, self.length - gap


def pack(items: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` of 1 to ``length``.

    Sequence ids are the group's number times 2^32 plus a count. Groups are dealt by row,
    so repeated rows and hot keys spread evenly.
    """
    items = stored(items, "pieces")
    groups = max(1, -(-items.count() // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        packer, group = SumOfSquares(length), table.column("group")[0].as_py() if table.num_rows else 0
        placed = [packer.put(s) for s in table.column("length").to_pylist()]
        ids = pa.array([(group << 32) + p[0] for p in placed], pa.int64())
        table = table.append_column("sequence_id", ids)
        return table.append_column("offset", pa.array([p[1] for p in placed], pa.int64())).drop_columns(["row", "group"])

    numbered = items.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "group", F.pmod(F.xxhash64("row"), F.lit(groups))
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return numbered.groupBy("group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, vocabulary, length), length)
