"""Token counts of whole texts by a public byte-level vocabulary, by overlap resynchronisation.

Texts up to ``size`` characters are encoded in one task.  Longer ones are cut into chunks
that reach ``overlap`` characters into the next; each chunk is encoded alone, with the
places of its stable boundaries and the tokens before each.  Two neighbours are spliced at a
boundary that both have in what they share.  Where they share none, chunks and overlaps
are made eight times as wide, until they do or the chunk is the text.

Why a splice is right: the vocabulary first splits at its special strings, then by a pattern
without look-behind in which white space can only begin a piece, then merges within pieces.
So a piece ends between a character that is no white space and a blank, tab or line end,
whatever stands before and after, and what follows is encoded as if the text began there.
The special strings hold no white space; no boundary lies within one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import TOKENIZERS
from .long_texts import LONGEST_REMEMBERED, REMEMBERED, batched, cut, is_long, spread, unit_pattern
from .tables import stored

VOCABULARY = "byte_bpe_50k.json"
WIDER = 8
_UNITS = unit_pattern(r" \t\n\r")
_MARKS = "array<struct<at: bigint, before: bigint>>"


class _Counter:
    """Numbers of tokens of units, remembered by a task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        if (special := [t.content for t in self.model.get_added_tokens_decoder().values() if any(c.isspace() for c in t.content) or t.lstrip or t.rstrip]):
            raise ValueError(f"special strings with white space would lie across boundaries: {special}")
        self.known: dict[str, int] = {}
        self.passing: list[str] = []  # known until the next call

    def learn(self, units: list[str]) -> dict[str, int]:
        """Numbers of tokens of these and earlier units."""
        for unit in self.passing:
            del self.known[unit]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(units) - self.known.keys())
        self.passing = [u for u in new if len(u) > LONGEST_REMEMBERED]
        if new:
            self.known.update(zip(new, [len(e.ids) for e in self.model.encode_batch_fast(new, add_special_tokens=False)]))
        return self.known


@cache
def _counter(path: str) -> _Counter:
    return _Counter(path)


def _counts(texts: list[str], counter: _Counter) -> list[int]:
    out = []
    for first, end in batched(texts):
        units = [_UNITS.findall(t) for t in texts[first:end]]
        known = counter.learn([u for one in units for u in one])
        out += [sum(map(known.__getitem__, one)) for one in units]
    return out


def boundaries(text: str, start: int, overlap: int, size: int, counter: _Counter) -> tuple[int, list[dict], list[dict]]:
    """Tokens of a chunk that begins at ``start``, and its boundaries (place, tokens before) in what it shares with either neighbour."""
    units = _UNITS.findall(text)
    known = counter.learn(units)
    ends = np.cumsum([len(u) for u in units], dtype=np.int64)
    before = np.cumsum([known[u] for u in units], dtype=np.int64)
    inner = slice(0, max(0, len(units) - 1))  # the chunk's own end is no boundary

    def within(low: int, high: int) -> list[dict]:
        at = slice(*np.searchsorted(ends[inner], [low, high], side="right"))
        return [{"at": start + int(e), "before": int(b)} for e, b in zip(ends[at], before[at])]

    return int(before[-1]) if len(before) else 0, within(0, overlap), within(size, size + overlap)


def _wider(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunks of texts, ``WIDER`` of them made one, which reach as many times further into the next."""
    group = F.floor(F.col("chunk") / WIDER).cast("long")
    own = F.struct(group.alias("to"), F.col("chunk").alias("k"), F.when(F.col("is_last"), F.col("part")).otherwise(F.substring("part", 1, size)).alias("t"))
    ahead = F.struct((group - 1).alias("to"), F.col("chunk").alias("k"), F.substring("part", 1, overlap * WIDER).alias("t"))
    led = (F.col("chunk") % WIDER == 0) & (F.col("chunk") > 0)
    dealt = chunks.select("key", "id", "is_last", "n_bytes", F.posexplode(F.when(led, F.array(own, ahead)).otherwise(F.array(own))).alias("ahead", "one"))
    return dealt.groupBy("key", F.col("one.to").alias("chunk")).agg(
        F.first("id").alias("id"), F.max(F.col("is_last") & (F.col("ahead") == 0)).alias("is_last"), F.sum(F.when(F.col("ahead") == 0, F.col("n_bytes")).otherwise(0)).alias("n_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("one.k", "one.t"))), lambda x: x["t"]), "").alias("part"),
    ).select("key", "id", "chunk", "is_last", "n_bytes", "part")


def _spliced(chunks: DataFrame, size: int, overlap: int, path: str) -> DataFrame:
    """(key, id, n_bytes, n_tokens, n_chunks, apart) of each text; ``apart`` counts neighbours that share no boundary."""
    id_type = chunks.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            starts = [k * size for k in batch.column("chunk").to_pylist()]
            found = [boundaries(t, s, overlap, size, counter) for t, s in zip(batch.column("part").to_pylist(), starts)]
            total, left, right = zip(*found) if found else ((), (), ())
            marks = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            kept = [batch.column(c) for c in ("key", "id", "chunk", "is_last", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(left, marks), pa.array(right, marks)], ["key", "id", "chunk", "is_last", "n_bytes", "total", "left", "right"])

    schema = f"key string, id {id_type}, chunk long, is_last boolean, n_bytes long, total long, `left` {_MARKS}, `right` {_MARKS}"
    encoded = spread(chunks, size).mapInArrow(work, schema)
    none = F.lit(None).cast(_MARKS)
    ends = F.when(F.col("is_last"), F.col("total"))
    sides = encoded.select("key", "id", F.explode(F.array(
        F.struct(F.col("chunk").alias("seam"), F.col("right").alias("before"), none.alias("after"), F.col("is_last"), ends.alias("end"), "n_bytes"),
        F.struct((F.col("chunk") - 1).alias("seam"), none.alias("before"), F.col("left").alias("after"), F.lit(False).alias("is_last"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("n_bytes")),
    )).alias("s")).select("key", "id", "s.*").where("seam >= 0")
    seams = sides.groupBy("key", "seam").agg(
        F.first("id").alias("id"), F.first("before", True).alias("before"), F.first("after", True).alias("after"),
        F.max("is_last").alias("is_last"), F.max("end").alias("end"), F.sum("n_bytes").alias("n_bytes"),
    )
    places = lambda c: F.transform(c, lambda x: x["at"])
    shared = F.array_min(F.array_intersect(places(F.col("before")), places(F.col("after"))))
    seams = seams.withColumn("shared", F.when(~F.col("is_last"), shared))
    tokens = lambda c: F.element_at(F.filter(c, lambda x: x["at"] == F.col("shared")), 1)["before"]
    part = F.when(F.col("is_last"), F.col("end")).when(F.col("shared").isNotNull(), tokens(F.col("before")) - tokens(F.col("after")))
    return seams.groupBy("key").agg(
        F.first("id").alias("id"), F.sum("n_bytes").alias("n_bytes"), F.sum(part).alias("n_tokens"), F.count("*").alias("n_chunks"),
        F.count_if(~F.col("is_last") & F.col("shared").isNull()).alias("apart"),
    )


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizers: str = TOKENIZERS,
    vocabulary: str = VOCABULARY, size: int = 1 << 15, overlap: int = 256,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit, n_chunks) of every row.

    ``vocabulary`` is a byte-level .json vocabulary in the folder ``tokenizers``, which every
    executor must have under one path.  Its special strings in a text are special tokens, no
    tokens are added, nothing is cut off.  Null and empty texts have no bytes and no tokens.
    Very long texts are counted in chunks in many tasks, with the same result.  Repeated rows
    and null ids are counted each; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < overlap * WIDER <= size:
        raise ValueError("overlap must be positive and at most an eighth of size")
    path = str(Path(tokenizers) / vocabulary)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, n_tokens long, n_chunks long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [pa.array(x, pa.int64()) for x in ([len(t.encode()) for t in texts], _counts(texts, counter), [1] * len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n], ["id", "n_bytes", "n_tokens", "n_chunks"])

    short = docs.where(~is_long(text_col, size)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("part")).mapInArrow(work, schema)
    chunks, done = cut(docs, id_col, text_col, size, overlap), []
    while True:
        spliced = stored(_spliced(chunks, size, overlap, path), "spliced")
        done.append(spliced.where("apart = 0"))
        apart = spliced.where("apart > 0").select("key")
        if apart.isEmpty():
            break
        chunks = stored(_wider(chunks.join(apart, "key", "left_semi"), size, overlap), "chunks")
        size, overlap = size * WIDER, overlap * WIDER
    for one in done:
        short = short.unionByName(one.select("id", "n_bytes", "n_tokens", "n_chunks"))
    return short.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
