"""The append-only ledger of decisions and what it says about today's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.digest import EVIDENCE, FINDING, RECORD, framed_digest

from .findings import identity_json

DECISIONS = ("needs_review", "acceptable", "confirmed_issue", "accepted_risk")
MAX_WATCHED = 32
MAX_RATIONALE_BYTES = 128 * 1024
_RECORD_FIELDS = ("finding_id", "revision", "decision", "rule_id", "code", "path", "start_byte", "end_byte", "matched_digest", "rule_digest", "file_digest", "context_digest", "engine_digest", "evidence_digest", "watched_files", "previous")


def record_digest(decisions: DataFrame) -> DataFrame:
    """``decisions`` with ``record_digest`` over the record's JSON and its rationale."""
    body = F.to_json(F.struct(*[F.col(c) for c in _RECORD_FIELDS if c in decisions.columns]))
    return decisions.withColumn("record_digest", framed_digest(RECORD, body, F.coalesce("rationale", F.lit(""))))


def record_digest_of(record: Column, rationale: Column) -> Column:
    return framed_digest(RECORD, record, rationale)


def validate_ledger(decisions: DataFrame) -> DataFrame:
    """(finding_id, revision, problem) of every broken rule of the ledger."""
    history = Window.partitionBy("finding_id").orderBy("revision")
    rows = decisions.withColumns({
        "_n": F.row_number().over(history), "_prior": F.lag("record_digest").over(history),
        "_id": framed_digest(FINDING, identity_json()),
        "_evidence": framed_digest(EVIDENCE, *[F.col(c) for c in ("finding_id", "rule_digest", "file_digest", "context_digest", "engine_digest")]),
    })
    form = "^sha256:[0-9a-f]{64}$"
    digests = [c for c in ("finding_id", "matched_digest", "rule_digest", "file_digest", "context_digest", "engine_digest", "evidence_digest", "record_digest") if c in decisions.columns]
    malformed = F.lit(False)
    for c in digests:
        malformed = malformed | ~F.coalesce(F.col(c).rlike(form), F.lit(False))
    checks = [
        (F.col("revision") != F.col("_n"), "revision_gap"),
        (~F.col("previous").eqNullSafe(F.col("_prior")), "broken_link"),
        (F.coalesce(F.trim("rationale"), F.lit("")) == "", "empty_rationale"),
        (F.coalesce(F.size("watched_files"), F.lit(0)) > MAX_WATCHED, "too_many_watched_files"),
        (malformed, "malformed_digest"),
        (~F.col("decision").isin(*DECISIONS), "unknown_decision"),
        (F.col("finding_id") != F.col("_id"), "identity_mismatch"),
        (F.col("evidence_digest") != F.col("_evidence"), "evidence_mismatch"),
    ]
    problems = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))
    return rows.select("finding_id", "revision", F.explode(problems).alias("problem"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last revision of each finding's record."""
    last = Window.partitionBy("finding_id").orderBy(F.desc("revision"))
    return decisions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def watched_state(latest: DataFrame, corpus: DataFrame) -> DataFrame:
    """(finding_id, watched_reasons): changed and missing watched files, by path."""
    rows = latest.select("finding_id", F.explode("watched_files").alias("path", "expected"))
    now = corpus.select("path", "file_digest")
    met = rows.join(now, "path", "left")
    reason = F.when(F.col("file_digest").isNull(), F.concat(F.lit("watched_file_missing:"), F.col("path"))).when(
        F.col("file_digest") != F.col("expected"), F.concat(F.lit("watched_file_changed:"), F.col("path"))
    )
    reasons = F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("path", reason.alias("r"))))), lambda x: x["r"])
    return met.groupBy("finding_id").agg(reasons.alias("watched_reasons"))


def status(kind: Column, decision: Column, validity: Column) -> Column:
    """accepted, needs_review, confirmed_issue or violation; a stale record reopens its finding."""
    accepts = decision.isin("acceptable", "accepted_risk") & (validity == "current")
    return (
        F.when(accepts, "accepted").when((validity == "current") & (decision == "confirmed_issue"), "confirmed_issue")
        .when(validity == "stale", "needs_review").when(kind == "review", "needs_review").otherwise("violation")
    )


def disposition(findings: DataFrame, latest: DataFrame, watched: DataFrame) -> DataFrame:
    """``findings`` with decision, validity, status and ``reasons`` in a fixed order."""
    prior = latest.select(
        "finding_id", F.col("decision").alias("_d"), F.col("revision").alias("revision"),
        *[F.col(c).alias(f"_{c}") for c in ("rule_digest", "file_digest", "context_digest", "engine_digest", "evidence_digest")],
    )
    rows = findings.join(prior, "finding_id", "left").join(watched, "finding_id", "left")
    changed = {c: F.col(c) != F.col(f"_{c}") for c in ("rule_digest", "file_digest", "context_digest", "engine_digest", "evidence_digest")}
    own = [
        F.when(changed["rule_digest"], F.lit("rule_package_changed")),
        F.when(changed["file_digest"], F.lit("owner_file_changed")),
        F.when(changed["engine_digest"], F.lit("runtime_semantics_changed")),
        F.when(changed["context_digest"] & ~changed["file_digest"], F.lit("repository_input_inventory_changed")),
    ]
    none = F.array().cast("array<string>")
    last = F.array_compact(F.array(F.when((F.col("_d") == "acceptable") & (F.col("kind") != "review"), F.lit("acceptable_requires_review_diagnostic"))))
    known = F.col("_d").isNotNull()
    reasons = F.when(known, F.concat(F.array_compact(F.array(*own)), F.coalesce("watched_reasons", none), last)).otherwise(none)
    moved = changed["context_digest"] | changed["evidence_digest"]
    rows = rows.withColumn("reasons", reasons)
    validity = F.when(~known, "unreviewed").when((F.size("reasons") > 0) | moved, "stale").otherwise("current")
    rows = rows.withColumn("validity", validity).withColumn("decision", F.coalesce("_d", F.lit("needs_review")))
    rows = rows.withColumn("status", status(F.col("kind"), F.col("decision"), F.col("validity")))
    return rows.drop("_d", "watched_reasons", *[f"_{c}" for c in changed])


def partition_findings(disposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actionable, reviewed): disjoint, and together all findings; reviewed ones never block."""
    reviewed = disposed.where("status = 'accepted'").withColumn("blocking", F.lit(False))
    return disposed.where("status != 'accepted'"), reviewed


def review_records(disposed: DataFrame, latest: DataFrame) -> DataFrame:
    """(finding_id, decision, revision, validity) of every record; not observed ones too."""
    seen = disposed.where("validity != 'unreviewed'").select("finding_id", "validity")
    rows = latest.select("finding_id", "decision", "revision").join(seen, "finding_id", "left")
    return rows.withColumn("validity", F.coalesce("validity", F.lit("not_observed")))


def duplicate_identities(findings: DataFrame) -> DataFrame:
    """(finding_id, n) of identities that more than one finding has; any row is an error."""
    return findings.groupBy("finding_id").agg(F.count("*").alias("n")).where("n > 1")


def judge_requests(latest: DataFrame, requests: DataFrame, findings: DataFrame, corpus: DataFrame, complete: bool = True) -> DataFrame:
    """``requests`` with ``reject_reason`` (null if accepted) and the next ``revision``.

    A request is (finding_id, decision, rationale, evidence_digest, expected_previous,
    watched_files).  Of several requests on one finding in a batch, none is accepted.
    """
    now = findings.select("finding_id", F.col("evidence_digest").alias("_evidence"), F.col("kind").alias("_kind")).dropDuplicates(["finding_id"])
    prior = latest.select("finding_id", F.col("record_digest").alias("_prior"), F.col("revision").alias("_revision"))
    many = requests.groupBy("finding_id").agg(F.count("*").alias("_many"))
    watched = requests.select("finding_id", F.explode("watched_files").alias("path", "expected")).join(corpus.select("path", "file_digest"), "path", "left")
    moved = watched.groupBy("finding_id").agg(F.bool_or(~F.col("expected").eqNullSafe(F.col("file_digest"))).alias("_moved"))
    rows = requests.join(now, "finding_id", "left").join(prior, "finding_id", "left").join(many, "finding_id").join(moved, "finding_id", "left")
    reason = (
        F.when(F.lit(not complete), "incomplete_run").when(F.col("_many") > 1, "duplicate_request").when(F.col("_evidence").isNull(), "not_observed")
        .when(F.col("_evidence") != F.col("evidence_digest"), "evidence_changed")
        .when(~F.col("decision").isin(*DECISIONS), "unknown_decision")
        .when((F.col("decision") == "acceptable") & (F.col("_kind") != "review"), "acceptable_requires_review_diagnostic")
        .when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "empty_rationale").when(F.octet_length("rationale") > MAX_RATIONALE_BYTES, "rationale_too_long")
        .when(~F.col("expected_previous").eqNullSafe(F.col("_prior")), "previous_record_changed")
        .when(F.coalesce(F.size("watched_files"), F.lit(0)) > MAX_WATCHED, "too_many_watched_files").when(F.coalesce("_moved", F.lit(False)), "watched_file_changed")
    )
    rows = rows.withColumn("reject_reason", reason).withColumn("revision", F.coalesce("_revision", F.lit(0)) + 1).withColumn("previous", F.col("_prior"))
    return rows.drop("_evidence", "_kind", "_prior", "_revision", "_many", "_moved")


def append_decisions(ledger: DataFrame, requests: DataFrame, findings: DataFrame, corpus: DataFrame, path: str | None = None, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests; accepted rows are appended to the Parquet ledger at ``path``, if given."""
    judged = judge_requests(latest_decisions(ledger), requests, findings, corpus, complete)
    accepted = judged.where("reject_reason is null").drop("reject_reason", "expected_previous")
    fields = [c for c in ("rule_id", "code", "path", "start_byte", "end_byte", "matched_digest", "rule_digest", "file_digest", "context_digest", "engine_digest") if c in findings.columns]
    accepted = record_digest(accepted.join(findings.select("finding_id", *fields).dropDuplicates(["finding_id"]), "finding_id"))
    if path:
        accepted.write.mode("append").parquet(path)
    return accepted, judged.where("reject_reason is not null")


def list_reviews(ledger: DataFrame, prefix_length: int = 12) -> DataFrame:
    """(finding_id, prefix, decision, revision, validity) of the last records, not evaluated."""
    return latest_decisions(ledger).select(
        "finding_id", F.substring(F.substring_index("finding_id", ":", -1), 1, prefix_length).alias("prefix"), "decision", "revision", F.lit("not_evaluated").alias("validity")
    )


def inspect(wanted: DataFrame, disposed: DataFrame, latest: DataFrame) -> DataFrame:
    """(finding_id, observation, path, status, decision, revision, reasons) for a table of ids."""
    seen = disposed.select("finding_id", "path", "status", "validity", "reasons", F.lit(True).alias("_seen"))
    rows = wanted.select("finding_id").distinct().join(seen, "finding_id", "left").join(latest.select("finding_id", "decision", "revision"), "finding_id", "left")
    observation = F.when(F.col("_seen"), "present").otherwise("not_observed")
    return rows.select("finding_id", observation.alias("observation"), "path", "status", "validity", "decision", "revision", "reasons")


def line_diff(old: DataFrame, new: DataFrame, decided: DataFrame) -> DataFrame:
    """(path, change, text, n): lines removed from and added to changed documents, as multisets.

    ``decided`` has (path, file_digest) as of the decision; where the old snapshot is not that
    content, the one row is ``previous_content_unavailable``.
    """
    from corpusward.functions.digest import with_digest

    from .patterns import lines

    a, b = with_digest(old).select("path", "text", F.col("file_digest").alias("_old")), with_digest(new).select("path", F.col("file_digest").alias("_new"))
    pairs = decided.select("path", F.col("file_digest").alias("_then")).distinct().join(a.drop("text"), "path", "left").join(b, "path", "left")
    lost = pairs.where(~F.col("_then").eqNullSafe(F.col("_old"))).select("path", F.lit("previous_content_unavailable").alias("change"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"))
    changed = pairs.where((F.col("_then") == F.col("_old")) & (F.col("_old") != F.col("_new"))).select("path")
    count = lambda df, name: lines(df.select("path", "text").join(changed, "path", "left_semi")).groupBy("path", "text").agg(F.count("*").alias(name))
    both = count(old, "o").join(count(new, "w"), ["path", "text"], "full")
    gap = F.coalesce("w", F.lit(0)) - F.coalesce("o", F.lit(0))
    moved = both.where(gap != 0).select("path", F.when(gap > 0, "added").otherwise("removed").alias("change"), "text", F.abs(gap).alias("n"))
    return moved.unionByName(lost)
