"""Corpus tables: reading, classification and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.digest import with_digest

#: Bytes in which a NUL makes a file binary.
SNIFFED = 8192


def read_corpus(spark: SparkSession, path: str, path_expr: str, text_col: str = "text", snapshot: str = "current") -> DataFrame:
    """A Parquet table as (path, text, snapshot); only the columns it needs are read."""
    return to_corpus(spark.read.parquet(path), F.expr(path_expr), F.col(text_col), snapshot)


def read_files(spark: SparkSession, path: str, snapshot: str = "current") -> DataFrame:
    """Plain files below a folder as (path, content, snapshot), for :func:`classify`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.lit(snapshot).alias("snapshot"))


def to_corpus(df: DataFrame, path: Column, text: Column, snapshot: str = "current") -> DataFrame:
    return df.select(path.alias("path"), text.alias("text"), F.lit(snapshot).alias("snapshot"))


def classify(df: DataFrame, max_bytes: int, content_col: str = "content") -> DataFrame:
    """(path, text, n_bytes, status, reason): checked, binary, or a gap with its reason.

    A NUL among the first bytes makes a file binary whatever its size; then size, a later
    NUL and the encoding are looked at, in that order.  Text is null unless checked.
    """
    content = F.col(content_col).cast("binary")
    size = F.octet_length(content).cast("long")
    # Hex digits in pairs: a NUL byte is a 00 at an even place.
    nul_at = lambda b: F.expr("true") & (F.locate("\x00", F.decode(b, "ISO-8859-1")) > 0)
    early, any_nul = nul_at(F.substring(content, 1, SNIFFED)), nul_at(content)
    text = content.cast("string")
    status = F.when(early, "binary").when(size > max_bytes, "gap").when(any_nul, "binary").when(~F.is_valid_utf8(text), "gap").otherwise("checked")
    reason = F.when(early, "nul_byte").when(size > max_bytes, "oversized").when(any_nul, "nul_byte").when(~F.is_valid_utf8(text), "invalid_utf8")
    out = df.withColumns({"status": status, "reason": reason, "n_bytes": size})
    return out.withColumn("text", F.when(F.col("status") == "checked", text)).select("path", "text", "n_bytes", "status", "reason")


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged, by path and content digest."""
    a = with_digest(old).select("path", F.col("file_digest").alias("old_digest"))
    b = with_digest(new).select("path", F.col("file_digest").alias("new_digest"))
    change = (
        F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "deleted")
        .when(F.col("old_digest") != F.col("new_digest"), "modified").otherwise("unchanged")
    )
    return a.join(b, "path", "full").select("path", change.alias("change"))


def check_changed(new: DataFrame, diff: DataFrame) -> DataFrame:
    """``new`` with ``status``: changed rows are checked, the rest serve cross-file rules only."""
    changed = diff.where(F.col("change").isin("added", "modified")).select("path", F.lit(True).alias("_changed"))
    status = F.when(F.col("_changed"), "checked").otherwise("unchanged_dependency")
    return new.join(changed, "path", "left").withColumn("status", status).drop("_changed")


def coverage(*parts: DataFrame) -> DataFrame:
    """(path, status, reason) of classified parts; a path has one row."""
    out = parts[0].select("path", "status", "reason")
    for part in parts[1:]:
        out = out.unionByName(part.select("path", "status", "reason"))
    return out


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("status", "reason").agg(F.count("*").alias("n_paths"))
