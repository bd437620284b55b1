"""Structural matches of markup elements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import find_all
from .spans import innermost, inside


def elements(df: DataFrame, tag: str, keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(keys, ord, start_byte, end_byte, open_tag, inner_start, inner_end) of each closed ``tag`` element.

    Opening and closing tags are paired by nesting depth: an opening tag at depth d closes at
    the next closing tag that returns to depth d.  Elements that never close are left out
    (see :func:`structure_gaps`).
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", tag):
        raise ValueError(f"not an element name: {tag!r}")
    marks = find_all(df, f"</{tag}>|<{tag}(?:[ \\n\\t][^>]*)?>", keys, text_col)
    opens = ~F.startswith("text", F.lit("</"))
    order = Window.partitionBy(*keys).orderBy("start_byte")
    step = F.when(opens, 1).otherwise(-1)
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(opens, 0).otherwise(1)
    marks = marks.withColumns({"_open": opens, "_depth": depth})
    nest = Window.partitionBy(*keys, "_depth").orderBy("start_byte")
    marks = marks.withColumns({
        "_close": F.lead("_open").over(nest), "_inner_end": F.lead("start_byte").over(nest), "_end": F.lead("end_byte").over(nest),
    }).where(F.col("_open") & (F.col("_close") == F.lit(False)))
    rank = Window.partitionBy(*keys).orderBy("start_byte")
    return marks.select(
        *keys, (F.row_number().over(rank) - 1).alias("ord"), "start_byte", F.col("_end").alias("end_byte"),
        F.col("text").alias("open_tag"), F.col("end_byte").alias("inner_start"), F.col("_inner_end").alias("inner_end"),
    )


def attribute(elements_: DataFrame, name: str) -> DataFrame:
    """``elements_`` with the value of a quoted attribute, null where it is absent."""
    pattern = f"[ \\n\\t]{re.escape(name)}=\"([^\"]*)\""
    value = F.when(F.col("open_tag").rlike(pattern), F.regexp_extract("open_tag", pattern, 1))
    return elements_.withColumn(name, value)


def node(elements_: DataFrame) -> DataFrame:
    """The inner region of each element as a span of its own."""
    keys = [c for c in elements_.columns if c not in ("ord", "start_byte", "end_byte", "open_tag", "inner_start", "inner_end")]
    return elements_.select(*keys, "ord", F.col("inner_start").alias("start_byte"), F.col("inner_end").alias("end_byte"))


def match_in_context(child: DataFrame, parent: DataFrame, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """Child elements under a parent element, each with its innermost parent's span."""
    return innermost(child, parent, keys)


def nested_search(df: DataFrame, outer: DataFrame, pattern: str, keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """Matches of a pattern inside the outer spans, in absolute bytes.

    The text is searched once and matches are kept by containment, so no region is copied.
    """
    return inside(find_all(df, pattern, keys, text_col), outer, keys)


def structure_gaps(df: DataFrame, tags: list[str], keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(keys, reason, unclosed): rows whose markup does not close; they are gaps, never without a match."""
    text = F.col(text_col)
    counts = [
        F.struct(F.lit(t).alias("tag"), (F.regexp_count(text, F.lit(f"<{t}(?:[ \\n\\t][^>]*)?>")) - F.regexp_count(text, F.lit(f"</{t}>"))).alias("n"))
        for t in tags
    ]
    open_ = F.transform(F.filter(F.array(*counts), lambda x: x["n"] != 0), lambda x: x["tag"])
    return df.select(*keys, F.lit("parse_error").alias("reason"), F.array_join(open_, ",").alias("unclosed")).where("unclosed != ''")
