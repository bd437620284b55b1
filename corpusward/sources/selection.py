"""Which paths of a corpus take part, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.globs import glob_regex
from corpusward.plans.written import written


def _patterns(entries: list[tuple]) -> list[tuple[str, tuple]]:
    return [(glob_regex(e[0]), e) for e in entries]


def exclusion_reason(path: Column, excludes: list[tuple[str, str]]) -> Column:
    """Reason of the first (glob, reason) that matches; null if none does.

    Policy lists are short, so they are one expression over the path and need no join.
    """
    out = F.lit(None).cast("string")
    for pattern, (_, reason) in reversed(_patterns(excludes)):
        out = F.when(path.rlike(pattern), reason).otherwise(out)
    return out


def apply_exclusions(df: DataFrame, excludes: list[tuple[str, str]]) -> DataFrame:
    """``df`` with ``status`` excluded and the first matching entry's reason, or checked."""
    reason = exclusion_reason(F.col("path"), excludes)
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "excluded").otherwise("checked"))


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Ordered (glob, negated) rules: the last that matches decides."""
    out = F.lit(False)
    for pattern, (_, negated) in _patterns(rules):
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def apply_ignore(df: DataFrame, rules: list[tuple[str, bool]], tracked: DataFrame | None = None) -> DataFrame:
    """``df`` with ``is_ignored``; tracked paths are always kept."""
    out = df.withColumn("is_ignored", ignored(F.col("path"), rules))
    if tracked is None:
        return out
    kept = tracked.select("path").distinct().withColumn("_tracked", F.lit(True))
    out = out.join(kept, "path", "left")
    return out.withColumn("is_ignored", F.col("is_ignored") & F.col("_tracked").isNull()).drop("_tracked")


def select_paths(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows at one of the paths, or below one that is a folder."""
    keep = F.lit(False)
    for prefix in prefixes:
        name = prefix.rstrip("/")
        keep = keep | (F.col("path") == name) | F.startswith(F.col("path"), F.lit(f"{name}/"))
    return df.where(keep)


def hidden_filter(df: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Without paths that have a component starting with a dot, unless they are wanted."""
    return df if include_hidden else df.where(~F.col("path").rlike("(^|/)\\."))


def cumulative_quota(df: DataFrame, max_files: int, max_bytes: int, block_rows: int = 1_000_000) -> DataFrame:
    """``df`` (path, n_bytes) with ``status`` and ``reason`` under budgets in path order.

    A file that breaks a budget is a gap and takes nothing from it, so a later, smaller file
    may still be let in: ``source_file_limit`` when the number of files is used up, else
    ``source_snapshot_limit``.  Paths are distinct.

    Files are let in run by run: among those that are small enough for what is left, the first
    that no longer fits ends a run and is found through the sums of blocks of paths, of which
    one is looked at row by row.  What is left shrinks below the size of that file each time.
    """
    parts = max(1, -(-df.count() // block_rows))
    rows = written(df.select("path", "n_bytes").repartitionByRange(parts, "path").withColumn("_block", F.spark_partition_id()), "paths")
    runs, files, size, after, full = [], 0, 0, None, None
    while files < max_files:
        fits = rows.where(F.col("n_bytes") <= max_bytes - size)
        fits = fits if after is None else fits.where(F.col("path") > after)
        f, b, found = files, size, None
        for block in fits.groupBy("_block").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).orderBy("_block").collect():  # one row a block
            if f + block["n"] >= max_files or b + block["b"] > max_bytes:
                upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # the rows of one block
                sums = fits.where(F.col("_block") == block["_block"]).select("path", "n_bytes", (F.count("*").over(upto) + f).alias("f"), (F.sum("n_bytes").over(upto) + b).alias("b"))
                found = sums.where((F.col("f") == max_files) | (F.col("b") > max_bytes)).orderBy("path").first()
                break
            f, b = f + block["n"], b + block["b"]
        last = None if found is None else found["path"]
        over = found is not None and found["b"] > max_bytes
        runs.append((after, last, over, max_bytes - size))
        if found is None:
            break
        files, size = (found["f"] - 1, found["b"] - found["n_bytes"]) if over else (found["f"], found["b"])
        after = last
        full = last if files == max_files else None
    path, let_in = F.col("path"), F.lit(False)
    for first, last, over, left in runs:
        inside = F.col("n_bytes") <= left
        inside = inside if first is None else inside & (path > first)
        let_in = let_in | (inside if last is None else inside & ((path < last) if over else (path <= last)))
    used_up = F.lit(max_files <= 0) if full is None else path > full
    reason = F.when(~let_in, F.when(used_up, "source_file_limit").otherwise("source_snapshot_limit"))
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "checked").otherwise("gap"))
