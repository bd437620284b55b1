"""Interval operators on byte spans.

A span is (path, start_byte, end_byte), half open.  Which spans are enclosed is told by a
sweep: spans of both sides in order of their starts, with the farthest end (or, backwards,
the nearest) of the other side so far.  It costs sorting, whatever encloses what.  A file's
spans are cut by blocks of bytes, and what reaches into a block is carried from the blocks
before as one number, so a file with very many spans is not one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file whose spans are swept by one task.
BLOCK = 1 << 20


def _outer(outer: DataFrame, keys: list[str]) -> DataFrame:
    return outer.select(*keys, F.col("start_byte").alias("outer_start"), F.col("end_byte").alias("outer_end"))


def within() -> Column:
    """Equal spans count, adjacent ones do not."""
    return (F.col("start_byte") >= F.col("outer_start")) & (F.col("end_byte") <= F.col("outer_end"))


def span_contains(outer: DataFrame, inner: DataFrame, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """(keys, outer_start, outer_end, start_byte, end_byte) of every pair in which outer encloses inner; as many rows as pairs."""
    return inner.join(_outer(outer, keys), keys).where(within()).select(*keys, "outer_start", "outer_end", "start_byte", "end_byte")


def _both(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, mine, until, row): the spans of both tables; ``row`` is a whole row of the first, with names of its own."""
    span = [F.col("start_byte").alias("_at"), F.col("end_byte").alias("_until")]
    named = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    one = rows.select(*named, *span, F.lit(1).alias("_mine"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    kind = one.schema["_row"].dataType
    two = others.dropna(subset=[*keys, "start_byte", "end_byte"]).select(*named, *span, F.lit(0).alias("_mine"), F.lit(None).cast(kind).alias("_row"))
    return one.unionByName(two)


def _swept(rows: DataFrame, others: DataFrame, keys: list[str], backwards: bool, block: int) -> DataFrame:
    """``rows`` as ``_row``, with the farthest end of the others that start before or with it.

    Backwards: the nearest end of those that start with or after it.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    every = _both(rows, others, keys).withColumn("_block", F.floor(F.col("_at") / block))
    edge, at = (F.min, F.desc("_at")) if backwards else (F.max, F.asc("_at"))
    theirs = F.when(F.col("_mine") == 0, F.col("_until"))
    here = Window.partitionBy(*names, "_block").orderBy(at, "_mine").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_reach", edge(theirs).over(here))
    # One row a file and block, and of files with several blocks only.
    blocks = every.groupBy(*names, "_block").agg(edge(theirs).alias("_edge"))
    order = F.desc("_block") if backwards else F.asc("_block")
    earlier = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", edge("_edge").over(earlier)).where("_carried is not null").select(*names, "_block", "_carried")
    every = every.where("_mine = 1").join(carried, [*names, "_block"], "left")
    return every.withColumn("_reach", (F.least if backwards else F.greatest)("_reach", "_carried"))


def _kept(swept: DataFrame, test: Column, columns: list[str]) -> DataFrame:
    return swept.where(test).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def _is_inside() -> Column:
    return F.coalesce(F.col("_reach") >= F.col("_until"), F.lit(False))


def inside(inner: DataFrame, outer: DataFrame, keys: list[str] = ["path"], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Inner spans that some outer span encloses."""
    return _kept(_swept(inner, outer, keys, False, block), _is_inside(), inner.columns)


def outside(inner: DataFrame, outer: DataFrame, keys: list[str] = ["path"], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Inner spans that no outer span encloses."""
    return _kept(_swept(inner, outer, keys, False, block), ~_is_inside(), inner.columns)


def with_inside(inner: DataFrame, outer: DataFrame, keys: list[str], name: str = "is_inside") -> DataFrame:
    """Inner spans with whether some outer span encloses them."""
    swept = _swept(inner, outer, keys, False, BLOCK)
    return swept.select(*[F.col(f"_row.`{c}`").alias(c) for c in inner.columns], _is_inside().alias(name))


def without_inner(outer: DataFrame, inner: DataFrame, keys: list[str] = ["path"], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Outer spans that enclose no inner span."""
    has = F.coalesce(F.col("_reach") <= F.col("_until"), F.lit(False))
    return _kept(_swept(outer, inner, keys, True, block), ~has, outer.columns)


def innermost(inner: DataFrame, outer: DataFrame, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """Each inner span with the enclosing outer span that starts last (of those, the shortest).

    Spans stream through a task in order of their starts, against a stack of outer spans:
    one that starts later and ends no earlier takes the place of those it covers, so ends fall
    from the bottom up and the enclosing span is found by bisection.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    # Dealt by an expression of its own: where both sides are dealt by the keys already, the plan drops an equal
    # exchange above their union, and then the sides' partitions are joined up unlike each other.
    every = _both(inner, outer, keys).repartition(F.xxhash64(*names)).sortWithinPartitions(*names, "_at", "_mine", F.desc("_until"))
    row = every.schema["_row"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, starts, ends = None, [], []  # ends with their signs changed, so that they rise
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*names, "_at", "_until", "_mine")]
            taken, found = [], []
            for k, (*own, at, until, mine) in enumerate(zip(*columns)):
                if own != file:
                    file, starts, ends = own, [], []
                if mine:
                    if until is not None and (n := bisect_right(ends, -until)):
                        taken.append(k)
                        found.append((starts[n - 1], -ends[n - 1]))
                    continue
                while ends and -ends[-1] <= until:
                    starts.pop(), ends.pop()
                starts.append(at), ends.append(-until)
            outer_start, outer_end = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(taken, pa.int64())), pa.array(outer_start, pa.int64()), pa.array(outer_end, pa.int64())], ["_row", "outer_start", "outer_end"])

    found = every.mapInArrow(work, f"_row {row.simpleString()}, outer_start long, outer_end long")
    rest = [c for c in inner.columns if c not in keys]
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in [*keys, *rest]], "outer_start", "outer_end")
