"""Best-fit packing of documents into sequences of several permitted lengths.

Sizes are numbers of tokens of a public vocabulary.  Pieces go in order of falling size to
the open sequence that they fill best.  Where none has room, a new one is opened at the
permitted length that costs least for each token it will hold: for every length that takes
the piece, the contents are planned from the pieces that are still to come, largest first.
In the end each sequence shrinks to the smallest permitted length that holds its contents.

Pieces are dealt by hash to shards of a bounded number of rows, which are packed
independently; only ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import TOKENIZERS, token_counts
from .tables import stored


def _planned(size: int, length: int, sizes_left: int, count: list[int]) -> int:
    """Tokens that a sequence of ``length`` opened for ``size`` can hold, filled with the largest pieces that fit."""
    room, taken = length - size, {}
    while room and (fit := sizes_left & ((2 << room) - 1)):
        n = fit.bit_length() - 1
        many = min(count[n] - taken.get(n, 0), room // n)
        room -= many * n
        taken[n] = taken.get(n, 0) + many
        if taken[n] == count[n]:
            sizes_left &= ~(1 << n)
    return length - room


def pack(sizes: list[int], lengths: tuple[int, ...], overhead: float) -> tuple[list[int], list[int], list[int]]:
    """(sequence, offset) of each size, in the order given, and the length of each sequence.

    Sizes must fall.  A sequence of length n costs n + ``overhead``.
    """
    lengths = tuple(sorted(lengths))
    count = [0] * (lengths[-1] + 1)
    for size in sizes:
        count[size] += 1
    sizes_left = sum(1 << n for n, many in enumerate(count) if many)  # bit n is set while a piece of size n is to come
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a sequence with room r is open
    where, offset = [], []
    for size in sizes:
        count[size] -= 1
        if not count[size]:
            sizes_left &= ~(1 << size)
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((n for n in lengths if n >= size), key=lambda n: ((n + overhead) / _planned(size, n, sizes_left, count), -n))
            at = len(used)
            used.append(0)
            opened.append(room)
        where.append(at)
        offset.append(used[at])
        used[at] += size
        room -= size
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return where, offset, [next(n for n in lengths if n >= u) for u in used]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096),
    overhead: float = 16.0,
    shard_rows: int = 20_000,
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """(id_col, piece, start_token, n_tokens, seq_id, seq_length, seq_offset) for every piece of every row.

    A size is a count of tokens.  Texts longer than the longest permitted length are cut
    into pieces of that length and a rest; nothing is dropped.  Null texts and texts
    without words give one piece of size 0 that needs no sequence (null seq_id).  Repeated
    rows are packed each.  Null ids are kept.  Other columns are ignored.  Reruns give the
    same sequences, however the rows are dealt to tasks.
    """
    longest = max(lengths)
    sized = token_counts(docs, id_col, text_col, tokenizers).withColumnRenamed("n_tokens", "size")
    # Rows of one id and size are alike; numbered, they are told apart and do not meet in one shard by their id alone.
    sized = sized.groupBy("id", "size").agg(F.count("*").alias("copies"))
    blocks = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 10_000))))
    first = F.col("block") * 10_000 + 1
    sized = blocks.select("id", "size", F.explode(F.sequence(first, F.least(first + 9_999, F.col("copies")))).alias("copy"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / longest)).cast("long")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("piece") * longest
    pieces = stored(pieces.select("id", "size", "copy", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).cast("long").alias("n")), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id", "size", "copy", "piece"), F.lit(shards)).cast("int")

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "descending"), ("id", "ascending"), ("size", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        where, offset, length = pack(group["n"].to_pylist(), lengths, overhead)
        base = group["shard"][0].as_py() << 32
        where = np.array(where, np.int64)
        new = {"seq_id": base + where, "seq_length": np.array(length, np.int64)[where], "seq_offset": np.array(offset, np.int64)}
        for name, values in new.items():
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.select(["id", "piece", "start", "n", *new])

    id_type = pieces.schema["id"].dataType.simpleString()
    full = pieces.where("n > 0").withColumn("shard", shard)
    packed = full.groupBy("shard").applyInArrow(
        work, f"id {id_type}, piece long, start long, n long, seq_id long, seq_length long, seq_offset long"
    )
    none = F.lit(None).cast("long")
    empty = pieces.where("n = 0").select("id", "piece", "start", "n", none.alias("seq_id"), none.alias("seq_length"), none.alias("seq_offset"))
    return packed.unionByName(empty).select(
        F.col("id").alias(id_col), "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"), "seq_id", "seq_length", "seq_offset"
    )
