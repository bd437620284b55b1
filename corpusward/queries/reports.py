"""Queries of summaries, statistics and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions.digest import with_digest
from corpusward.functions.globs import glob_regex
from corpusward.operators import detect, fixtures, report, scope
from corpusward.sources import corpus as source

from .base import CORPUS_SQL, RULES, RULES_SQL, SCOPE_SQL, corpus, doc_path, query, rule_rows, spans_sql, table
from .detection import MATCHES, _gaps, raw
from .ledger import DISPOSED, disposed

_COUNTS = f"""counts AS (SELECT rule_id, mode, intent, severity, count(path) AS n_files FROM rules LEFT JOIN corpus ON mode <> 'disabled' AND {SCOPE_SQL} GROUP BY ALL)"""
_ERRORS = "errs AS (SELECT DISTINCT rule_id FROM (SELECT rule_id FROM found GROUP BY rule_id, path HAVING count(*) > 3))"
_SUMMARY = f"""{_COUNTS}, {_ERRORS}, summary AS (SELECT rule_id, CASE WHEN mode = 'disabled' THEN 'disabled' WHEN rule_id IN (SELECT rule_id FROM errs) THEN 'failed' WHEN n_files = 0 THEN 'not_applicable' ELSE 'completed' END AS status, n_files AS checked_files FROM counts)"""


def _summary(spark, sf_dir):
    every = rule_rows(spark, enabled=False)
    checked = scope.scoped_file_counts(every.where("mode != 'disabled'"), corpus(spark, sf_dir))
    _, errors = detect.enforce_limits(raw(spark, sf_dir), 3)
    return report.rule_summary(every, checked, errors)


@query(f"WITH {MATCHES}, {_SUMMARY} SELECT rule_id, status, checked_files FROM summary")
def j1_rule_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def _classified(spark, sf_dir):
    from .sources import _content

    return source.classify(_content(spark, sf_dir), 6000)


_CLASSES = f"""c3 AS (SELECT CASE WHEN k = 1 OR k = 3 AND n <= 8192 THEN 'binary' WHEN n > 6000 THEN 'gap' WHEN k = 3 THEN 'binary' WHEN k = 2 THEN 'gap' ELSE 'checked' END AS status
  FROM (SELECT doc_id % 11 AS k, strlen(text) + CASE WHEN doc_id % 11 IN (1, 2, 3) THEN 1 ELSE 0 END AS n FROM documents))"""
_CHECK = f"""a AS (SELECT count(*) AS raw_findings, count_if(status = 'accepted')::BIGINT AS reviewed, count_if(status <> 'accepted')::BIGINT AS actionable, count_if(status <> 'accepted' AND mode = 'enforced')::BIGINT AS blocking, count_if(status <> 'accepted' AND mode <> 'enforced')::BIGINT AS advisory,
  count_if(status <> 'accepted' AND kind = 'review')::BIGINT AS review_kind, count_if(status = 'confirmed_issue')::BIGINT AS known_issues FROM disposed),
b AS (SELECT count_if(status = 'checked')::BIGINT AS checked_files, count_if(status = 'binary')::BIGINT AS binary_skips, count_if(status = 'gap')::BIGINT AS gaps FROM c3)"""


@query(f"WITH {DISPOSED}, {_CLASSES}, {_CHECK} SELECT * FROM a, b")
def j2_check_summary(spark, sf_dir):
    return report.check_summary(disposed(spark, sf_dir)[0], _classified(spark, sf_dir))


#: (rule_id, minimum_files): what rules are expected to cover, as parameters.
_EXPECT = [("local/licence", 10), ("local/address", 10**9), ("local/mail", 1), ("global/insult", 5), ("global/off", 1), ("local/nowhere", 1), ("local/absent", 1), ("local/token", 1)]
_GAPS = f"gaps AS (SELECT rule_id, count(*) AS n_gaps FROM pairs WHERE strlen(text) > 6000 AND rule_id IN ('local/mail', 'local/token') GROUP BY rule_id)"


@query(f"""WITH {MATCHES}, {_SUMMARY}, {_GAPS}, e(rule_id, minimum_files) AS (VALUES {', '.join(f"('{r}', {n}::BIGINT)" for r, n in _EXPECT)})
SELECT e.rule_id, minimum_files, CASE WHEN s.status = 'failed' THEN 0 ELSE coalesce(checked_files, 0) END AS completed_files, coalesce(n_gaps, 0) AS source_gaps,
  CASE WHEN s.status IS NULL THEN 'missing_rule' WHEN s.status = 'disabled' THEN 'disabled' WHEN s.status = 'failed' OR coalesce(n_gaps, 0) > 0 THEN 'incomplete' WHEN s.status = 'not_applicable' THEN 'not_applicable' WHEN checked_files < minimum_files THEN 'insufficient_files' ELSE 'satisfied' END AS status
FROM e LEFT JOIN summary s USING (rule_id) LEFT JOIN gaps USING (rule_id)""")
def j3_coverage_expectations(spark, sf_dir):
    expect = spark.createDataFrame(_EXPECT, "rule_id string, minimum_files long")
    some = rule_rows(spark).where(F.col("rule_id").isin("local/mail", "local/token"))
    gaps = scope.scope_join(some, _gaps(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n_gaps"))
    return report.coverage_expectations(expect, _summary(spark, sf_dir), gaps)


@query(f"""WITH {DISPOSED}, {_CLASSES}, {_CHECK}, {_ERRORS}, z AS (SELECT *, (SELECT count(*) FROM errs) AS n_errors FROM a, b), y AS (SELECT *, n_errors = 0 AND checked_files > 0 AND gaps = 0 AS complete FROM z)
SELECT complete, CASE WHEN NOT complete THEN 'incomplete' WHEN actionable = 0 AND checked_files = 0 THEN 'no_work' WHEN actionable = 0 THEN 'pass' ELSE 'findings' END AS status, CASE WHEN NOT complete THEN 2 WHEN blocking > 0 THEN 1 ELSE 0 END AS exit_code, checked_files = 0 AS no_eligible_files FROM y""")
def j4_check_outcome(spark, sf_dir):
    _, errors = detect.enforce_limits(raw(spark, sf_dir), 3)
    return report.check_outcome(report.check_summary(disposed(spark, sf_dir)[0], _classified(spark, sf_dir)), errors.select("rule_id").distinct())


_STATS = f"""{_COUNTS}, decs AS (SELECT rule_id, count_if(decision = 'acceptable')::BIGINT AS acceptable, count_if(decision = 'confirmed_issue')::BIGINT AS confirmed_issue, count_if(decision = 'accepted_risk')::BIGINT AS accepted_risk, count_if(decision = 'needs_review')::BIGINT AS needs_review FROM led GROUP BY rule_id),
fnd AS (SELECT rule_id, count(*) AS raw_findings, count_if(validity = 'stale')::BIGINT AS stale_decisions FROM disposed GROUP BY rule_id),
um AS (SELECT rule_id, count(*) AS unmatched_includes FROM (VALUES ('local/nowhere', '^nowhere/.*$'), ('local/nowhere', '^src2/(es|fr)/[^/]*$'), ('local/token', '^src[0-4]/.*$'), ('local/mail', '^[^/]*/en/.*$'), ('local/mail', '^[^/]*/de/.*$'), ('global/licence', '^src[^/]/en/[^/]*$')) g(rule_id, re) WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE regexp_matches(path, re)) GROUP BY rule_id),
st AS (SELECT rule_id, mode, severity, intent, n_files AS scoped_files, coalesce(unmatched_includes, 0) AS unmatched_includes, coalesce(raw_findings, 0) AS raw_findings, coalesce(stale_decisions, 0) AS stale_decisions, coalesce(acceptable, 0) AS acceptable, coalesce(confirmed_issue, 0) AS confirmed_issue, coalesce(accepted_risk, 0) AS accepted_risk, coalesce(needs_review, 0) AS needs_review
  FROM counts LEFT JOIN decs USING (rule_id) LEFT JOIN fnd USING (rule_id) LEFT JOIN um USING (rule_id)),
stats AS (SELECT *, CASE WHEN mode = 'disabled' THEN 'disabled' WHEN confirmed_issue > 0 THEN 'useful' WHEN scoped_files = 0 THEN 'dead' WHEN intent = 'watch' AND raw_findings + acceptable + accepted_risk + needs_review > 0 THEN 'watch' WHEN raw_findings + acceptable + accepted_risk + needs_review = 0 THEN 'quiet'
  WHEN acceptable * 2 > acceptable + accepted_risk THEN 'noisy' ELSE 'active' END AS signal FROM st)"""


def _stats(spark, sf_dir):
    d, latest = disposed(spark, sf_dir)
    every, files = rule_rows(spark, enabled=False), corpus(spark, sf_dir)
    on = every.where("mode != 'disabled'")
    globs = spark.createDataFrame([(r[0], g, glob_regex(g)) for r in RULES if r[2] != "disabled" for g in r[6]], "rule_id string, glob string, regex string")
    unmatched = scope.unmatched_includes(globs, files)
    return report.rule_stats(every, scope.scoped_file_counts(on, files), unmatched, d, latest)


@query(f"WITH {DISPOSED}, {_STATS} SELECT * FROM stats")
def j5_rule_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"WITH {DISPOSED}, {_STATS} SELECT rule_id, signal FROM stats")
def j6_signal(spark, sf_dir):
    return _stats(spark, sf_dir).select("rule_id", "signal")


@query(f"WITH {DISPOSED}, {_STATS} SELECT CAST(rank AS INTEGER) AS rank, s.signal, count(stats.signal) AS n_rules FROM (VALUES (0, 'useful'), (1, 'noisy'), (2, 'active'), (3, 'watch'), (4, 'quiet'), (5, 'dead'), (6, 'unknown'), (7, 'disabled')) s(rank, signal) LEFT JOIN stats USING (signal) GROUP BY ALL")
def j7_signal_histogram(spark, sf_dir):
    return report.signal_histogram(_stats(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL} SELECT (SELECT count(*) FROM corpus) AS source_rows, (SELECT sum(strlen(text))::BIGINT FROM corpus) AS bytes_hashed, (SELECT max(strlen(text))::BIGINT FROM corpus) AS largest_file,
  (SELECT count(*) FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL}) AS rule_file_pairs, (SELECT count(*) FROM rules WHERE mode <> 'disabled') AS requested_queries, (SELECT count(DISTINCT regex) FROM rules WHERE mode <> 'disabled') AS distinct_queries,
  (SELECT count_if(doc_id % 10 NOT IN (3, 4) AND rule_id <> 'local/mail')::BIGINT FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL}) AS store_hits, (SELECT count_if(doc_id % 10 IN (3, 4) OR rule_id = 'local/mail')::BIGINT FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL}) AS store_misses""")
def j8_work_counters(spark, sf_dir):
    from corpusward.plans.incremental import check_incremental

    from .ledger import _keyed_rules, _stored_results

    files = corpus(spark, sf_dir)
    _, _, counts = check_incremental(_keyed_rules(spark), files, _stored_results(spark, sf_dir))
    rows = rule_rows(spark)
    return report.work_counters(with_digest(files), scope.scope_join(rows, files), rows, counts)


_FIXTURE = f"""fx AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'local/licence' WHEN 1 THEN 'local/address' ELSE 'local/mail' END AS rule_id, 'case ' || source AS case_name, path, text, doc_id FROM (SELECT path, text, doc_id, source FROM corpus JOIN (SELECT doc_id, source FROM documents) USING (doc_id))),
fr AS (SELECT rule_id, case_name, path, code, kind, regex, fx.text FROM fx JOIN rules USING (rule_id) WHERE {SCOPE_SQL}),
act AS ({spans_sql('rule_id, case_name, path, code, kind', 'fr')})"""


def _fixture_files(spark, sf_dir):
    k = F.col("doc_id") % 3
    rule = F.when(k == 0, "local/licence").when(k == 1, "local/address").otherwise("local/mail")
    return table(spark, sf_dir, "documents").select(rule.alias("rule_id"), F.concat(F.lit("case "), "source").alias("case_name"), doc_path().alias("path"), "text", "doc_id")


def _actual(spark, sf_dir):
    return fixtures.run_fixtures(rule_rows(spark), _fixture_files(spark, sf_dir).drop("doc_id"))


@query(f"WITH {CORPUS_SQL}, {RULES_SQL}, {_FIXTURE} SELECT rule_id, case_name, path, code, kind, start_byte, end_byte FROM act")
def k1_run_fixtures(spark, sf_dir):
    return _actual(spark, sf_dir)


def _expected(spark, sf_dir):
    """What the cases expect: the findings, some without spans, and in some sources one moved."""
    a = _actual(spark, sf_dir)
    moved = F.col("case_name").isin("case src3", "case src4")
    start = F.when(F.col("start_byte") % 2 == 0, F.col("start_byte") + F.when(moved, 1).otherwise(0))
    return a.withColumns({"start_byte": start, "end_byte": F.when(F.col("start_byte") % 2 == 0, F.col("end_byte"))})


_PASSED = f"""{_FIXTURE}, cases AS (SELECT DISTINCT rule_id, case_name FROM fx), passed AS (SELECT rule_id, case_name, NOT (case_name IN ('case src3', 'case src4') AND EXISTS (SELECT 1 FROM act WHERE act.rule_id = cases.rule_id AND act.case_name = cases.case_name AND start_byte % 2 = 0)) AS passed FROM cases)"""


def _outcomes(spark, sf_dir):
    return fixtures.compare_expected(_actual(spark, sf_dir), _expected(spark, sf_dir), _fixture_files(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, {RULES_SQL}, {_PASSED} SELECT rule_id, case_name, passed FROM passed")
def k2_compare_expected(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"WITH {CORPUS_SQL}, {RULES_SQL}, {_PASSED}, bad AS (SELECT DISTINCT rule_id FROM passed WHERE NOT passed) SELECT rule_id, CASE WHEN rule_id IN (SELECT rule_id FROM bad) THEN 'fixtures_failed' END AS error FROM rules WHERE mode <> 'disabled'")
def k3_fixture_gate(spark, sf_dir):
    kept, errors = fixtures.fixture_gate(rule_rows(spark), _outcomes(spark, sf_dir))
    return kept.select("rule_id", F.lit(None).cast("string").alias("error")).unionByName(errors)


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, {_FIXTURE}, ap AS (SELECT rule_id, case_name, bool_or(fx.text <> '') AS nonempty FROM fx JOIN rules USING (rule_id) WHERE {SCOPE_SQL} GROUP BY rule_id, case_name),
ev AS (SELECT rule_id, bool_or((rule_id, case_name) IN (SELECT (rule_id, case_name) FROM act)) AS p, bool_or((rule_id, case_name) NOT IN (SELECT (rule_id, case_name) FROM act) AND nonempty) AS n FROM ap GROUP BY rule_id)
SELECT rule_id, coalesce(p, FALSE) AS has_positive, coalesce(n, FALSE) AS has_negative, mode <> 'enforced' OR (coalesce(p, FALSE) AND coalesce(n, FALSE)) AS enough FROM rules LEFT JOIN ev USING (rule_id) WHERE mode <> 'disabled'""")
def k4_enforcement_evidence(spark, sf_dir):
    return fixtures.enforcement_evidence(rule_rows(spark), _fixture_files(spark, sf_dir).drop("doc_id"), _expected(spark, sf_dir))
