"""Very long texts as rows of bounded size, so that the parts of one text go to many tasks.

A text is cut into chunks at fixed distances, each reaching ``overlap`` characters into the
next.  Vocabularies split a text, whatever stands around, between a character that is no
white space and a blank or line end; such places are *stable boundaries*, and the stretches
between them are *units*, whose tokens can be remembered.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Characters of a text that are worked on at a time.
STEP = 1 << 20
#: Units longer than this are not remembered.
LONGEST_REMEMBERED = 64
#: Units that a task remembers.
REMEMBERED = 1 << 19


def unit_pattern(before: str) -> re.Pattern:
    """Matches units; ``before`` holds the white space characters that a boundary may stand before."""
    # White space that Python knows and a vocabulary may not (such as U+001C) never makes a boundary.
    return re.compile(rf"\s*\S+(?:(?![{before}])\s+(?:\S+|\Z))*|\s+")


def batched(texts: list[str], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``step`` characters each."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= step:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def is_long(text_col: str, size: int):
    return F.coalesce(F.char_length(F.col(text_col)) > size, F.lit(False))


def cut(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, id, chunk, is_last, n_bytes, part) of the rows whose text has more than ``size`` characters.

    Chunk k holds the characters from k * size to (k + 1) * size + overlap; ``n_bytes`` is the
    text's length in bytes in chunk 0 and 0 in the others.  Every row has a key of its own.
    The chunks are written to the shared folder, so keys are the same for all later reads.
    """
    long = docs.where(is_long(text_col, size)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("part"))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, text = batch.column(0).slice(k, 1), batch.column(1)[k].as_py()
                key, n = uuid.uuid4().hex, -(-len(text) // size)
                for first in range(0, n, max(1, STEP // size)):
                    chunks = range(first, min(n, first + max(1, STEP // size)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(chunks)), ids.take(pa.array([0] * len(chunks))), pa.array(chunks, pa.int64()), pa.array([c == n - 1 for c in chunks]),
                            pa.array([0 if c else len(text.encode()) for c in chunks], pa.int64()), pa.array([text[c * size : (c + 1) * size + overlap] for c in chunks], pa.string()),
                        ],
                        ["key", "id", "chunk", "is_last", "n_bytes", "part"],
                    )

    return stored(long.mapInArrow(work, f"key string, id {id_type}, chunk long, is_last boolean, n_bytes long, part string"), "chunks")


def spread(chunks: DataFrame, characters: int, per_task: int = 1 << 21) -> DataFrame:
    """Written chunks of about ``characters`` dealt to tasks of about ``per_task`` characters, however long their texts are."""
    tasks = -(-chunks.count() * characters // per_task)
    return chunks.repartition(max(tasks, chunks.sparkSession.sparkContext.defaultParallelism), "key", "chunk")
