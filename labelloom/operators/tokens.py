"""Training rows: token ids and loss masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from labelloom.functions import constants as C

VOCABULARY = 32_000
BOS_ID = 1
# Texts given to a user tokenizer at once, in rows and bytes.
TOKENISE_ROWS = 512
TOKENISE_BYTES = 1 << 20


def word_ids(text: str, limit: int) -> str:
    """Ids of the first white-space separated words of a text expression.

    An id is a digest of the word, folded to the vocabulary. Words past the limit are
    cut off before they are hashed.
    """
    words = f"slice(filter(split({text}, '\\\\s+'), w -> w != ''), 1, {limit})"
    return f"transform({words}, w -> cast(cast(conv(substring(md5(w), 1, 6), 16, 10) as bigint) % {VOCABULARY} as int))"


def tokenise_words(df: DataFrame, max_length: int = C.MAX_LENGTH) -> DataFrame:
    """Add input_ids (with a start token) and prompt_ids, both cut to ``max_length``."""
    full = f"concat(array({BOS_ID}), {word_ids('concat(prompt, completion)', max_length - 1)})"
    return df.withColumn("input_ids", F.expr(full)).withColumn("prompt_ids", F.expr(word_ids("prompt", max_length)))


def tokenise(
    df: DataFrame,
    make_tokenizer: Callable[[], Callable[[list[str], bool], list[list[int]]]],
    max_length: int = C.MAX_LENGTH,
) -> DataFrame:
    """Same columns from a user tokenizer, built once per task.

    The tokenizer takes texts and whether to add its special tokens. It gets slices of a
    bounded number of rows and bytes, and only cut ids are kept, so a task's memory doesn't
    grow with its batches. Both columns are made by one worker.
    """
    added = [StructField(c, ArrayType(IntegerType())) for c in ("input_ids", "prompt_ids")]
    kept = [c for c in df.columns if c not in ("input_ids", "prompt_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer()

        def encode(texts: pa.Array, special: bool) -> pa.Array:
            return pa.array([ids[:max_length] for ids in tokenizer(texts.to_pylist(), special)], pa.list_(pa.int32()))

        for b in batches:
            for part in _slices(b):
                full, prompt = part.column("_full"), part.column("_prompt")
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], encode(full, True), encode(prompt, False)], [*kept, *[f.name for f in added]]
                )

    schema = StructType([*[df.schema[c] for c in kept], *added])
    texts = [F.concat("prompt", "completion").alias("_full"), F.col("prompt").alias("_prompt")]
    order = dict.fromkeys([*df.columns, *[f.name for f in added]])
    return df.select(*kept, *texts).mapInArrow(run, schema).select(*order)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``TOKENISE_ROWS`` rows and about ``TOKENISE_BYTES`` of text, one row at least."""
    sizes = pa.compute.binary_length(batch.column("_full")).fill_null(0).to_pylist()
    first = taken = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == TOKENISE_ROWS or taken + size > TOKENISE_BYTES):
            yield batch.slice(first, i - first)
            first, taken = i, 0
        taken += size
    if first < batch.num_rows:
        yield batch.slice(first)


def mask_labels(df: DataFrame, ignore: int = C.IGNORE_INDEX) -> DataFrame:
    """Add attention_mask and labels; rows without any label left are dropped.

    The start token is absent from prompt_ids, hence one more masked place.
    """
    length = F.size("input_ids")
    hidden = F.least(F.size("prompt_ids") + 1, length)
    labels = F.concat(
        F.array_repeat(F.lit(ignore), hidden), F.slice("input_ids", hidden + 1, F.greatest(length - hidden, F.lit(0)))
    )
    return (
        df.withColumn("attention_mask", F.array_repeat(F.lit(1), length))
        .withColumn("labels", labels)
        .filter(length > hidden)
    )
