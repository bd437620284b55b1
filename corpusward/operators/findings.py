"""From raw spans to findings: coordinates, snippets, policy and identity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.digest import (
    CONTEXT,
    EVIDENCE,
    FINDING,
    REPOSITORY_RESULT,
    RESULT,
    framed_digest,
    json_array,
    json_text,
    text_digest,
)


def _bytes_before(text: Column, at: Column) -> Column:
    return F.substring(text.cast("binary"), F.lit(1), at.cast("int")).cast("string")


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def add_coordinates(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """``raw`` with one-based line and column (in code points) of start and end."""
    both = raw.join(corpus.select("path", "text"), "path")
    cols = {}
    for side in ("start", "end"):
        before = _bytes_before(F.col("text"), F.col(f"{side}_byte"))
        last = F.element_at(F.split(before, "\n", -1), -1)
        cols[f"{side}_line"] = (F.size(F.split(before, "\n", -1))).cast("long")
        cols[f"{side}_column"] = (F.length(last) + 1).cast("long")
    return both.withColumns(cols).drop("text")


def add_snippet(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """``raw`` with ``snippet``: lines before, at and after the start, where the caret ends, extra lines."""
    both = raw.join(corpus.select("path", "text"), "path")
    parts = F.split(F.col("text"), "\n", -1)
    before = F.split(_bytes_before(F.col("text"), F.col("start_byte")), "\n", -1)
    matched = F.split(_between(F.col("text"), F.col("start_byte"), F.col("end_byte")), "\n", -1)
    line = F.size(before)
    start_column = F.length(F.element_at(before, -1)) + 1
    snippet = F.struct(
        F.when(line > 1, F.try_element_at(parts, line - 1)).alias("before"),
        F.element_at(parts, line).alias("line"),
        F.try_element_at(parts, line + 1).alias("after"),
        (start_column + F.length(matched[0])).cast("long").alias("caret_end_column"),
        (F.size(matched) - 1).cast("long").alias("extra_lines"),
    )
    return both.withColumn("snippet", snippet).drop("text")


def enrich(raw: DataFrame, rules: DataFrame, diagnostics: DataFrame, strict: bool = False) -> DataFrame:
    """``raw`` with kind, severity, mode, message, help and ``blocking``."""
    rows = raw.join(rules.select("rule_id", "severity", "mode"), "rule_id").join(diagnostics.select("rule_id", "code", "kind", "message", "help"), ["rule_id", "code"])
    return rows.withColumn("blocking", (F.col("mode") == "enforced") | (F.lit(strict) & (F.col("mode") == "advisory")))


def identity_json() -> Column:
    return json_array(
        json_text(F.col("rule_id")), json_text(F.col("code")), json_text(F.col("path")),
        F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), json_text(F.col("matched_digest")),
    )


def add_identity(findings: DataFrame) -> DataFrame:
    """Findings (with rule, file, context, engine and matched digests) with finding_id and evidence_digest."""
    out = findings.withColumn("finding_id", framed_digest(FINDING, identity_json()))
    parts = [F.col(c) for c in ("finding_id", "rule_digest", "file_digest", "context_digest", "engine_digest")]
    return out.withColumn("evidence_digest", framed_digest(EVIDENCE, *parts))


def with_matched_digest(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """``raw`` with the digest of the bytes it marks, the file's digest and a file rule's context digest."""
    both = raw.join(corpus.select("path", "text"), "path")
    matched = _between(F.col("text"), F.col("start_byte"), F.col("end_byte"))
    out = both.withColumns({"matched_digest": text_digest(matched), "file_digest": text_digest(F.col("text"))}).drop("text")
    return out.withColumn("context_digest", framed_digest(CONTEXT, F.col("path"), F.col("file_digest")))


def context_digests(members: DataFrame) -> DataFrame:
    """(rule_id, context_digest) of cross-file rules over all their (rule_id, path, file_digest), by path.

    The pinned form frames every pair in one digest, which cannot be cut: a rule's pairs (paths
    and digests, no texts) stream through one task in the order of a sort that may spill, and are
    hashed as they come, so memory does not grow with their number and time grows in proportion.
    A pair without path or digest takes no part; a rule of such pairs only has a null digest.
    """
    # Dealt by an expression of its own: a plan drops an exchange that its input seems to have made already.
    rows = members.select("rule_id", "path", "file_digest").repartition(F.xxhash64("rule_id")).sortWithinPartitions("rule_id", "path", "file_digest")
    return rows.mapInArrow(_hashed, f"rule_id {rows.schema['rule_id'].dataType.simpleString()}, context_digest string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of (rule_id, path, file_digest) rows with the same rule."""
    framed_bytes = lambda text: len(raw := text.encode()).to_bytes(8, "big") + raw
    rules, digests = [], []
    for batch in batches:
        for rule, path, digest in zip(*[c.to_pylist() for c in batch.columns]):
            if not rules or rule != rules[-1]:
                rules.append(rule), digests.append(None)
            if path is not None and digest is not None:
                digests[-1] = digests[-1] or hashlib.sha256(framed_bytes(CONTEXT))
                digests[-1].update(framed_bytes(path) + framed_bytes(digest))
    if rules:
        yield pa.RecordBatch.from_arrays([pa.array(rules, batch.column(0).type), pa.array([d and f"sha256:{d.hexdigest()}" for d in digests], pa.string())], ["rule_id", "context_digest"])


def result_key(profile: str = "default") -> Column:
    """Key of a file rule's result on a file: rule execution, scope, limits, path and content."""
    return framed_digest(RESULT, F.col("execution_digest"), F.col("include_re"), F.col("exclude_re"), F.lit(profile), F.col("path"), F.col("file_digest"))


def repository_result_key(rules: DataFrame, members: DataFrame, profile: str = "default") -> DataFrame:
    """(rule_id, result_key) of cross-file rules: every member file counts, so does its absence."""
    rows = rules.select("rule_id", "execution_digest").join(context_digests(members), "rule_id", "left")
    key = framed_digest(REPOSITORY_RESULT, F.col("execution_digest"), F.lit(profile), F.coalesce("context_digest", F.lit("")))
    return rows.select("rule_id", key.alias("result_key"))


def short_prefix(ids: DataFrame, id_col: str = "finding_id", least: int = 8) -> DataFrame:
    """(prefix_length): the least number of hex digits, 8 or more, by which all ids differ.

    Ids are dealt by their first digits and only neighbours in each share are compared, so no
    task sees all of them; ids in different shares differ in those digits.
    """
    digits = F.substring_index(F.col(id_col), ":", -1)
    rows = ids.select(digits.alias("d")).distinct().withColumn("head", F.substring("d", 1, least))
    near = F.lag("d").over(Window.partitionBy("head").orderBy("d"))
    shared = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(F.col("d"), F.lit(1), k) == F.substring(F.col("p"), F.lit(1), k)), k).otherwise(n))
    longest = rows.withColumn("p", near).where("p is not null").withColumn("shared", shared)
    return longest.agg(F.greatest(F.lit(least), F.coalesce(F.max("shared"), F.lit(0)) + 1).cast("long").alias("prefix_length"))


def resolve_prefix(ids: DataFrame, wanted: DataFrame, id_col: str = "finding_id") -> DataFrame:
    """(wanted, outcome, n_candidates, finding_id): full ids pass; 8 or more hex digits resolve if unique."""
    known = ids.select(F.col(id_col).alias("id")).distinct().withColumn("head", F.substring(F.substring_index("id", ":", -1), 1, 8))
    asked = wanted.select("wanted").distinct().withColumn("digits", F.substring_index("wanted", ":", -1))
    asked = asked.withColumn("head", F.when(F.col("digits").rlike("^[0-9a-f]{8,64}$"), F.substring("digits", 1, 8)))
    met = asked.join(known, "head", "left").withColumn("hit", F.startswith(F.substring_index("id", ":", -1), F.col("digits")))
    out = met.groupBy("wanted").agg(F.count_if("hit").alias("n_candidates"), F.min(F.when(F.col("hit"), F.col("id"))).alias("one"))
    outcome = F.when(F.col("n_candidates") == 1, "resolved").when(F.col("n_candidates") > 1, "ambiguous").otherwise("unmatched")
    return out.select("wanted", outcome.alias("outcome"), "n_candidates", F.when(F.col("n_candidates") == 1, F.col("one")).alias("finding_id"))
