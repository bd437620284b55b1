"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A document's place in its source is a hash of its id.  Sums of sizes by source and hash
bucket give the bucket where a budget ends; only that bucket is summed again, by finer
hash digits, until the threshold is known.  Documents below it are taken: nothing is
sorted, thresholds of larger budgets contain those of smaller ones, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, stored

#: Words are runs of other characters than space and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of the hash that one level of the histograms resolves, and the number of levels.
DIGITS, LEVELS = 3, 3


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(id_: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, DIGITS * LEVELS)
    return F.conv(digits, 16, 10).cast("long")


def _sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums over the rows before each in ``order``, which is total.

    Rows are dealt by ranges of the order; sums run inside each range and start at the sums
    of the ranges before, so the whole order is never in one task.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = parts.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = [(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()]
    return parts.join(F.broadcast(totals), "range").select(*rows.columns, *found)


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source.

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times the source's size and its excess is reshared.
    The fixed point is target = min(most * size, level * weight) for one common level.
    """
    numbered = _sums_before(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", weight.cast("long").alias("weight"))
    rows = rows.withColumn("ratio", F.col("source_size") / F.col("weight"))
    # In order of size per weight, the full sources come first; the level is right at the first that is not full.
    rows = _sums_before(rows, [F.col("ratio"), F.col("source").asc_nulls_last()], {"full": F.col("source_size") * most, "weighed": F.col("weight")})
    every = sources.agg(F.sum("source_size").alias("all_sizes")).crossJoin(rows.agg(F.sum("weight").alias("all_weights")))  # one row each
    rows = rows.crossJoin(F.broadcast(every))
    rows = rows.withColumn("level", (F.col("all_sizes") - F.col("full")).cast("double") / (F.col("all_weights") - F.col("weighed")))
    open_ = F.col("source_size") * most >= F.col("level") * F.col("weight")
    first = rows.where(open_).agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("level"))
    cap = (F.col("source_size") * most).cast("double")
    return rows.drop("level").crossJoin(F.broadcast(first)).select(
        "source", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target")
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, size, place).

    Every document of a source is taken ``whole`` times, and once more if its place is
    below ``threshold``.  One row a source; a hot source only has more in its sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(stored(sources, "sources"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("long"))
    state = goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = stored(state, "budgets")
    for level in range(LEVELS):
        below = DIGITS * 4 * (LEVELS - 1 - level)
        bound = state.select(F.col("source").alias("s"), "prefix", "budget")
        inside = sized.join(bound, sized["source"].eqNullSafe(F.col("s"))).where(
            F.shiftright("place", below + DIGITS * 4) == F.col("prefix")
        )
        bins = inside.groupBy("source", "budget", F.shiftright("place", below).alias("bin")).agg(F.sum("size").alias("in_bin"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("in_bin").over(upto)).where(F.col("upto") > F.col("budget"))
        edge = bins.groupBy(F.col("source").alias("s")).agg(
            F.min("bin").alias("bin"),
            F.min_by(F.col("budget") - F.col("upto") + F.col("in_bin"), "bin").alias("rest"),
            F.min_by("in_bin", "bin").alias("in_bin"),
        )
        state = state.join(edge, state["source"].eqNullSafe(F.col("s")), "left")
        prefix = F.coalesce("bin", F.lit(0))
        if level == LEVELS - 1:  # the last bin goes to the nearer side
            prefix = prefix + F.when(F.col("rest") * 2 >= F.col("in_bin"), 1).otherwise(0)
        state = stored(state.select(
            "source", "source_size", "target", "whole", prefix.cast("long").alias("prefix"),
            F.coalesce("rest", F.lit(0.0)).alias("budget"),
        ), "budgets")
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("threshold"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _place(F.col(id_col)).alias("place")
    )


def taken(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts the words the mix takes of the row, repeats included: at most ``most``
    times its size.  Null texts have size 0; null sources are one source, sorted last;
    rows that repeat an id (or have a null id) share a place and are taken alike.  Other
    columns are ignored.  A source's sum is within one place's rows of its target.
    """
    sized = stored(_sized(docs, id_col, source_col, text_col), "sizes")
    goal = thresholds(sized, weights, most).withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("place") < F.col("threshold")).cast("long")
    return sized.join(goal, sized["source"].eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, repeated as often as they are taken.

    The texts are not shuffled: the thresholds, one row a source, are joined to them.  Rows
    without words weigh nothing and follow the same thresholds.
    """
    sized = stored(_sized(docs, id_col, source_col, text_col), "sizes")
    goal = thresholds(sized, weights, most)
    names = {c: free_name(docs, c) for c in ("s", "whole", "threshold", "copy")}
    goal = goal.select(F.col("source").alias(names["s"]), F.col("whole").alias(names["whole"]), F.col("threshold").alias(names["threshold"]))
    copies = F.col(names["whole"]) + (_place(F.col(id_col)) < F.col(names["threshold"])).cast("long")
    rows = docs.join(goal, F.col(source_col).eqNullSafe(F.col(names["s"]))).where(copies > 0)
    return rows.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB: the same thresholds by cumulative sums in hash order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE),
         weight * (SELECT arg_min(level, source_size / weight) FROM l WHERE source_size * 3 >= level * weight)) AS target
  FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS whole FROM t
), p AS (
  SELECT source, place, sum(size) AS in_place, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM d GROUP BY source, place
), e AS (
  SELECT p.source, min(place) AS place, arg_min(target - whole * source_size - upto + in_place, place) AS rest, arg_min(in_place, place) AS in_place
  FROM p JOIN w ON p.source IS NOT DISTINCT FROM w.source WHERE upto > target - whole * source_size GROUP BY p.source
)
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(d.size * (w.whole + CASE WHEN d.place < e.place OR d.place = e.place AND e.rest * 2 >= e.in_place THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
