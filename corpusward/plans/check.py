"""The whole check of a corpus as one plan.

Classify the files, gate the rules, scope, detect incrementally, apply limits, tell findings
apart, match them with the ledger, and sum up.  Detection runs once and its findings are
written; everything after reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.digest import text_digest, with_digest
from corpusward.operators import detect, findings, fixtures, ledger, report, scope
from corpusward.sources import corpus as source

from .incremental import STORE, check_incremental, with_context
from .written import written


@dataclass(frozen=True)
class Check:
    """The tables of one run."""

    findings: DataFrame  #: with policy, coordinates, snippet, identity, decision, validity and status
    errors: DataFrame  #: (rule_id, path, error)
    coverage: DataFrame  #: (path, status, reason)
    rules: DataFrame  #: (rule_id, status, checked_files)
    summary: DataFrame  #: one row of counts
    outcome: DataFrame  #: one row: complete, status, exit_code, no_eligible_files
    hits: DataFrame  #: (rule_id, hits, misses) of stored results
    fresh: DataFrame  #: rows to append to the store


def check(
    rules: DataFrame, diagnostics: DataFrame, files: DataFrame, store: DataFrame | None = None, decisions: DataFrame | None = None,
    fixture_outcomes: DataFrame | None = None, max_bytes: int = 64 << 20, per_rule_file: int = 1000, strict: bool = False, engine: str = "engine 1",
) -> Check:
    """Check (path, content) files by rule rows.

    ``rules`` has (rule_id, code, mode, severity, regex[, flags], include_re, exclude_re,
    require_files, execution_digest), one row a pattern; ``diagnostics`` (rule_id, code, kind,
    message, help); ``store`` and ``decisions`` are earlier results and the ledger, both
    optional; ``fixture_outcomes`` (rule_id, case_name, passed) stop the rules that fail.
    Disabled rules, rules with a file missing that they require, and rules with a pattern
    outside the language do not run; the last are errors.  A rule that finds too much in one
    file loses what it found there, and so do findings that cannot be told apart.
    """
    spark = rules.sparkSession
    classified = written(source.classify(files, max_bytes), "classified")
    corpus = classified.where("status = 'checked'").select("path", "text")
    rows = rules.where("mode != 'disabled'")
    problem = lambda df, error: df.select("rule_id", F.lit(None).cast("string").alias("path"), F.lit(error).alias("error")).distinct()
    errors = problem(detect.pattern_errors(rows), "invalid_pattern")
    if fixture_outcomes is not None:
        rows, failing = fixtures.fixture_gate(rows, fixture_outcomes)
        errors = errors.unionByName(problem(failing, "fixtures_failed"))
    shapes = rows.select("rule_id", "include_re", "exclude_re", "require_files").distinct()
    applicable = scope._small(scope.require_files(shapes, classified).where("applicable").select("rule_id"))
    rows = rows.join(applicable, "rule_id", "left_semi")

    found, fresh, hits = check_incremental(rows, corpus, store if store is not None else spark.createDataFrame([], STORE))
    found, over = detect.enforce_limits(found, per_rule_file)
    found = findings.enrich(with_context(found), rows.select("rule_id", "severity", "mode").distinct(), diagnostics, strict)
    digests = {"rule_digest": F.col("execution_digest"), "engine_digest": text_digest(F.lit(engine))}
    found = found.join(rows.select("rule_id", "execution_digest").distinct(), "rule_id").withColumns(digests).drop("execution_digest")
    found = written(findings.add_identity(found).distinct(), "findings")
    twice = ledger.duplicate_identities(found)
    errors = errors.unionByName(over.select("rule_id", "path", "error")).unionByName(
        found.join(twice, "finding_id", "left_semi").select("rule_id", "path", F.lit("duplicate_identity").alias("error")).distinct()
    )
    errors = written(errors, "errors")
    found = found.join(twice, "finding_id", "left_anti")

    if decisions is None:
        none = F.lit(None)
        disposed = found.withColumns({
            "revision": none.cast("int"), "reasons": F.array().cast("array<string>"), "validity": F.lit("unreviewed"), "decision": F.lit("needs_review"),
            "status": ledger.status(F.col("kind"), F.lit("needs_review"), F.lit("unreviewed")),
        })
    else:
        latest = ledger.latest_decisions(decisions)
        disposed = ledger.disposition(found, latest, ledger.watched_state(latest, with_digest(corpus)))
    disposed = written(disposed, "disposed")
    checked = hits.select("rule_id", (F.col("hits") + F.col("misses")).alias("n_files"))
    status = report.rule_summary(rules.select("rule_id", "mode").distinct(), checked, errors)
    summary = written(report.check_summary(disposed, classified), "summary")
    return Check(disposed, errors, source.coverage(classified), status, summary, report.check_outcome(summary, errors), hits, fresh)
