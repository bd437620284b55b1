"""Summaries, coverage expectations and rule statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule signals in the order they are listed.
SIGNALS = ("useful", "noisy", "active", "watch", "quiet", "dead", "unknown", "disabled")


def rule_summary(rules: DataFrame, checked: DataFrame, errors: DataFrame) -> DataFrame:
    """(rule_id, status, checked_files) from (rule_id, mode), (rule_id, n_files) and (rule_id) of errors."""
    failed = errors.select("rule_id", F.lit(True).alias("_failed")).distinct()
    rows = rules.select("rule_id", "mode").join(checked.select("rule_id", "n_files"), "rule_id", "left").join(failed, "rule_id", "left")
    n = F.coalesce("n_files", F.lit(0))
    status = F.when(F.col("mode") == "disabled", "disabled").when(F.col("_failed"), "failed").when(n == 0, "not_applicable").otherwise("completed")
    return rows.select("rule_id", status.alias("status"), F.when(F.col("mode") == "disabled", 0).otherwise(n).cast("long").alias("checked_files"))


def check_summary(disposed: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row of counts over findings and covered paths."""
    reviewed = F.col("status") == "accepted"
    counts = disposed.agg(
        F.count("*").alias("raw_findings"), F.count_if(reviewed).alias("reviewed"), F.count_if(~reviewed).alias("actionable"),
        F.count_if(~reviewed & F.col("blocking")).alias("blocking"), F.count_if(~reviewed & ~F.col("blocking")).alias("advisory"),
        F.count_if(~reviewed & (F.col("kind") == "review")).alias("review_kind"), F.count_if(F.col("status") == "confirmed_issue").alias("known_issues"),
    )
    files = coverage.agg(
        F.count_if(F.col("status") == "checked").alias("checked_files"), F.count_if(F.col("status") == "binary").alias("binary_skips"), F.count_if(F.col("status") == "gap").alias("gaps")
    )
    return counts.crossJoin(files)  # one row each


def coverage_expectations(expectations: DataFrame, summary: DataFrame, gap_counts: DataFrame, partial: bool = False, omitted: str | None = None) -> DataFrame:
    """(rule_id, minimum_files, completed_files, source_gaps, status): the first rule that applies decides."""
    rows = expectations.join(summary.select("rule_id", F.col("status").alias("_s"), "checked_files"), "rule_id", "left").join(gap_counts.select("rule_id", "n_gaps"), "rule_id", "left")
    checked, gaps = F.coalesce("checked_files", F.lit(0)), F.coalesce("n_gaps", F.lit(0))
    left_out = F.startswith("rule_id", F.lit(f"{omitted}/")) if omitted else F.lit(False)
    status = (
        F.when(left_out, "missing_rule").when(F.lit(partial), "not_evaluated_partial").when(F.col("_s").isNull(), "missing_rule").when(F.col("_s") == "disabled", "disabled")
        .when((F.col("_s") == "failed") | (gaps > 0), "incomplete").when(F.col("_s") == "not_applicable", "not_applicable")
        .when(checked < F.col("minimum_files"), "insufficient_files").otherwise("satisfied")
    )
    done = F.when(F.col("_s") == "failed", 0).otherwise(checked).cast("long")
    return rows.select("rule_id", "minimum_files", done.alias("completed_files"), gaps.cast("long").alias("source_gaps"), status.alias("status"))


def unmet(expected: DataFrame) -> DataFrame:
    """(rule_id, error) of expectations that make a run incomplete."""
    return expected.where(~F.col("status").isin("satisfied", "not_evaluated_partial")).select("rule_id", F.lit("coverage_expectation_unmet").alias("error"))


def check_outcome(summary: DataFrame, errors: DataFrame, allow_empty: bool = False, changed_only: bool = False) -> DataFrame:
    """(complete, status, exit_code, no_eligible_files) of a run, from its summary row and its errors."""
    rows = summary.crossJoin(errors.agg(F.count("*").alias("_errors")))  # one row each
    empty = F.lit(not allow_empty) & ~(F.lit(changed_only) & (F.col("gaps") == 0)) & (F.col("checked_files") == 0)
    complete = (F.col("_errors") == 0) & ~empty & (F.col("gaps") == 0)
    status = F.when(~complete, "incomplete").when((F.col("actionable") == 0) & (F.col("checked_files") == 0), "no_work").when(F.col("actionable") == 0, "pass").otherwise("findings")
    code = F.when(~complete, 2).when(F.col("blocking") > 0, 1).otherwise(0)
    return rows.select(complete.alias("complete"), status.alias("status"), code.alias("exit_code"), empty.alias("no_eligible_files"))


def signal(mode: Column, complete: Column, intent: Column, scoped: Column, raw: Column, acceptable: Column, confirmed: Column, decided: Column, open_: Column) -> Column:
    """The first that is true of a rule; ``decided`` counts its decisions, ``open_`` those still in need of review."""
    touched = (raw > 0) | (decided > 0) | (open_ > 0)
    return (
        F.when(mode == "disabled", "disabled").when(~complete, "unknown").when(confirmed > 0, "useful").when(scoped == 0, "dead")
        .when((intent == "watch") & touched, "watch").when(~touched, "quiet").when((decided > 0) & (acceptable * 2 > decided), "noisy").otherwise("active")
    )


def rule_stats(rules: DataFrame, scoped: DataFrame, unmatched: DataFrame, disposed: DataFrame, latest: DataFrame, complete: bool = True) -> DataFrame:
    """One row a rule: files in scope, unmatched includes, findings, decisions by outcome, stale ones, signal."""
    decisions = latest.groupBy("rule_id").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("acceptable", "confirmed_issue", "accepted_risk", "needs_review")])
    found = disposed.groupBy("rule_id").agg(F.count("*").alias("raw_findings"), F.count_if(F.col("validity") == "stale").alias("stale_decisions"))
    globs = unmatched.groupBy("rule_id").agg(F.count("*").alias("unmatched_includes"))
    rows = rules.select("rule_id", "mode", "severity", "intent")
    for part in (scoped.select("rule_id", F.col("n_files").alias("scoped_files")), globs, found, decisions):
        rows = rows.join(part, "rule_id", "left")
    counts = ["scoped_files", "unmatched_includes", "raw_findings", "stale_decisions", "acceptable", "confirmed_issue", "accepted_risk", "needs_review"]
    rows = rows.fillna(0, counts)
    if not complete:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("raw_findings", "stale_decisions")})
    decided = F.col("acceptable") + F.col("confirmed_issue") + F.col("accepted_risk")
    return rows.withColumn("signal", signal(F.col("mode"), F.lit(complete), F.col("intent"), F.col("scoped_files"), F.coalesce("raw_findings", F.lit(0)), F.col("acceptable"), F.col("confirmed_issue"), decided, F.col("needs_review")))


def signal_histogram(stats: DataFrame) -> DataFrame:
    """(rank, signal, n_rules) for all signals, zeros too."""
    every = stats.sparkSession.createDataFrame(list(enumerate(SIGNALS)), "rank int, signal string")
    counts = stats.groupBy("signal").agg(F.count("*").alias("n"))
    return every.join(counts, "signal", "left").select("rank", "signal", F.coalesce("n", F.lit(0)).alias("n_rules")).orderBy("rank")


def work_counters(corpus: DataFrame, pairs: DataFrame, uses: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: texts read and bytes hashed, rule-file pairs, requested and distinct queries, store hits and misses."""
    a = corpus.agg(F.count("*").alias("source_rows"), F.sum("n_bytes").alias("bytes_hashed"), F.max("n_bytes").alias("largest_file"))
    b = pairs.agg(F.count("*").alias("rule_file_pairs"))
    c = uses.agg(F.count("*").alias("requested_queries"), F.count_distinct("regex").alias("distinct_queries"))
    d = hits.agg(F.sum("hits").alias("store_hits"), F.sum("misses").alias("store_misses"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
