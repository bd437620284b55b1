"""Queries of identity, incremental checks and the review ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions.digest import FINDING, framed_digest, text_digest, with_digest
from corpusward.functions.globs import any_glob_regex
from corpusward.operators import findings, ledger
from corpusward.operators.detect import compile_rules
from corpusward.operators.scope import _small, scope_join
from corpusward.operators.patterns import LOCATED
from corpusward.plans import incremental
from corpusward.plans.check import check
from corpusward.plans.written import written
from corpusward.sources.rules import execution_digests
from corpusward.streaming.paths import shared_folder

from .base import CORPUS_SQL, RULES, RULES_SQL, SCOPE_SQL, corpus, digest_sql, doc_path, query, rule_rows, rules, spans_sql, table
from .detection import MATCHES, diagnostics, located

_RULE_DIGEST, _ENGINE = "'sha256:' || sha256(rule_id)", "'sha256:' || sha256('engine 1')"
_ID_JSON = """('["' || rule_id || '","' || code || '","' || path || '",' || start_byte || ',' || end_byte || ',"' || matched_digest || '"]')"""
#: Findings with their digests and identities.
FOUND = f"""{MATCHES}, dig AS (SELECT f.rule_id, f.path, f.code, f.start_byte, f.end_byte, f.kind, f.mode, 'sha256:' || sha256(f.text) AS matched_digest, 'sha256:' || sha256(c.text) AS file_digest FROM found f JOIN corpus c USING (path)),
dig2 AS (SELECT *, {_RULE_DIGEST} AS rule_digest, {_ENGINE} AS engine_digest, {digest_sql('WT-REVIEW-CONTEXT-1', 'path', 'file_digest')} AS context_digest, {digest_sql('WT-FINDING-1', _ID_JSON)} AS finding_id FROM dig),
ids AS (SELECT *, {digest_sql('WT-REVIEW-EVIDENCE-1', 'finding_id', 'rule_digest', 'file_digest', 'context_digest', 'engine_digest')} AS evidence_digest FROM dig2)"""


def found(spark, sf_dir):
    """Findings with policy, digests and identities."""
    r = findings.enrich(located(spark, sf_dir), rule_rows(spark), diagnostics(spark))
    return findings.add_identity(r.withColumns({"rule_digest": text_digest(F.col("rule_id")), "engine_digest": text_digest(F.lit("engine 1"))}))


def found_once(spark, sf_dir):
    """The same, written, for queries that read it several times."""
    return written(found(spark, sf_dir).drop(*LOCATED), "found")


@query(f"SELECT doc_id, {digest_sql('WT-FINDING-1', 'text', 'source', 'lang')} AS digest FROM documents")
def h1_framed_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", framed_digest(FINDING, F.col("text"), F.col("source"), F.col("lang")).alias("digest"))


@query(f"WITH {FOUND} SELECT rule_id, path, start_byte, matched_digest, finding_id, evidence_digest FROM ids")
def h2_add_identity(spark, sf_dir):
    return found(spark, sf_dir).select("rule_id", "path", "start_byte", "matched_digest", "finding_id", "evidence_digest")


_PARTS = "list(struct_pack(p := path, d := 'sha256:' || sha256(text)) ORDER BY path)"


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, m AS (SELECT rule_id, {_PARTS} AS parts FROM corpus, rules WHERE rule_id IN ('local/token', 'global/licence') AND {SCOPE_SQL} GROUP BY rule_id),
u AS (SELECT rule_id, string_agg(lower(hex(unhex(lpad(printf('%x', strlen(x.p)), 16, '0')) || encode(x.p) || unhex(lpad(printf('%x', strlen(x.d)), 16, '0')) || encode(x.d))), '' ORDER BY x.p) AS body FROM (SELECT rule_id, unnest(parts) AS x FROM m) GROUP BY rule_id)
SELECT rule_id, 'sha256:' || sha256(unhex(lower(hex(unhex(lpad(printf('%x', 19), 16, '0')) || encode('WT-REVIEW-CONTEXT-1'))) || body)) AS context_digest FROM u""")
def h3_context_digest(spark, sf_dir):
    some = rule_rows(spark).where(F.col("rule_id").isin("local/token", "global/licence"))
    files = with_digest(corpus(spark, sf_dir)).select("path", "file_digest")
    return findings.context_digests(scope_join(some, files).join(files, "path"))


def _keyed_rules(spark):
    return rule_rows(spark).join(_small(execution_digests(rules(spark))), "rule_id")


_FLAGS_JSON = ",".join(f'"{f}":false' for f in ("case_insensitive", "multi_line", "dot_matches_new_line", "ignore_whitespace", "crlf"))
_EXECUTION = f"""('{{"rule_id":' || to_json(rule_id) || ',"execution":"file","patterns":{{"p":{{"regex":' || to_json(regex) || ',"flags":{{{_FLAGS_JSON}}}}}}},"codes":["' || code || '"]}}')"""
_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
#: The rules' execution digests, and their scopes in the form that a key holds.
_KEYED = f"""forms(rule_id, i, e) AS (VALUES {', '.join(f"({_QUOTED(r[0])}, {_QUOTED(any_glob_regex(r[6]) or '(?!)')}, {_QUOTED(any_glob_regex(r[7]) or '(?!)')})" for r in RULES)}),
keyed AS (SELECT *, {digest_sql('execution-1', _EXECUTION)} AS execution FROM rules JOIN forms USING (rule_id) WHERE mode <> 'disabled')"""


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, {_KEYED}, p AS (SELECT rule_id, path, execution, i, e, 'sha256:' || sha256(text) AS file_digest FROM corpus, keyed WHERE {SCOPE_SQL})
SELECT rule_id, path, {digest_sql('WT-RAW-FILE-3', 'execution', 'i', 'e', "'default'", 'path', 'file_digest')} AS result_key FROM p""")
def h4_result_key(spark, sf_dir):
    return incremental.keyed_pairs(_keyed_rules(spark), corpus(spark, sf_dir)).select("rule_id", "path", "result_key")


_MEMBERS = """string_agg(lower(hex(unhex(lpad(printf('%x', strlen(path)), 16, '0')) || encode(path) || unhex(lpad(printf('%x', strlen({d})), 16, '0')) || encode({d}))), '' ORDER BY path)"""
_FRAME = "'sha256:' || sha256(unhex(lower(hex(unhex(lpad(printf('%x', 19), 16, '0')) || encode('WT-REVIEW-CONTEXT-1'))) || {body}))"


def _repository_key(name: str, digest: str, where: str) -> str:
    body = f"SELECT rule_id, {_MEMBERS.format(d='d')} AS body FROM (SELECT rule_id, path, {digest} AS d FROM corpus, keyed WHERE {SCOPE_SQL} AND {where}) GROUP BY rule_id"
    key = digest_sql("repository-result-1", "execution", "'default'", "context")
    return f"""{name} AS (SELECT rule_id, {key} AS {name} FROM (SELECT k.rule_id, execution, coalesce({_FRAME.format(body='body')}, '') AS context FROM keyed k LEFT JOIN ({body}) b USING (rule_id)))"""


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, {_KEYED}, {_repository_key('as_is', "'sha256:' || sha256(text)", 'TRUE')},
{_repository_key('edited', "'sha256:' || sha256(CASE WHEN path LIKE 'src5/en/%' THEN path ELSE text END)", 'TRUE')}, {_repository_key('fewer', "'sha256:' || sha256(text)", "NOT (path LIKE 'src0/en/%' OR path LIKE 'src2/%')")}
SELECT rule_id, as_is, edited, fewer FROM as_is JOIN edited USING (rule_id) JOIN fewer USING (rule_id) WHERE rule_id IN ('local/token', 'global/licence')""")
def h5_repository_result_key(spark, sf_dir):
    files = written(with_digest(corpus(spark, sf_dir)).select("path", "file_digest"), "files")
    some = _keyed_rules(spark).where(F.col("rule_id").isin("local/token", "global/licence"))

    def keys(f, name):
        return findings.repository_result_key(some, scope_join(some, f).join(f, "path")).withColumnRenamed("result_key", name)

    edited = files.withColumn("file_digest", F.when(F.col("path").like("src5/en/%"), text_digest(F.col("path"))).otherwise(F.col("file_digest")))
    fewer = files.where("path not like 'src0/en/%' and path not like 'src2/%'")
    return keys(files, "as_is").join(keys(edited, "edited"), "rule_id").join(keys(fewer, "fewer"), "rule_id")


def _stored_results(spark, sf_dir):
    """What a run over an earlier snapshot stored: without some documents, and with others' old text."""
    docs = corpus(spark, sf_dir)
    k = F.pmod(F.regexp_extract("path", "([0-9]+)[.]txt", 1).cast("long"), F.lit(10))
    old = docs.where(k != 3).withColumn("text", F.when(k == 4, F.concat("text", F.lit(" old 1.2.3.4"))).otherwise(F.col("text")))
    early = _keyed_rules(spark).where("rule_id != 'local/mail'")
    return incremental.check_incremental(early, old, spark.createDataFrame([], incremental.STORE))[1]


@query(f"""WITH {MATCHES}, h AS (SELECT rule_id, count_if(doc_id % 10 NOT IN (3, 4) AND rule_id <> 'local/mail')::BIGINT AS hits, count_if(doc_id % 10 IN (3, 4) OR rule_id = 'local/mail')::BIGINT AS misses FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL} GROUP BY rule_id)
SELECT h.rule_id, hits, misses, (SELECT count(*) FROM found f WHERE f.rule_id = h.rule_id) AS n_findings FROM h""")
def h6_check_incremental(spark, sf_dir):
    every, _, counts = incremental.check_incremental(_keyed_rules(spark), corpus(spark, sf_dir), _stored_results(spark, sf_dir))
    n = every.groupBy("rule_id").agg(F.count("*").alias("n"))
    return counts.join(n, "rule_id", "left").select("rule_id", "hits", "misses", F.coalesce("n", F.lit(0)).alias("n_findings"))


@query(f"WITH {MATCHES} SELECT rule_id, path, code, start_byte, end_byte FROM found")
def h6_incremental_findings(spark, sf_dir):
    return incremental.check_incremental(_keyed_rules(spark), corpus(spark, sf_dir), _stored_results(spark, sf_dir))[0].select("rule_id", "path", "code", "start_byte", "end_byte")


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, m AS (SELECT DISTINCT regex, path FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL} AND (doc_id % 10 IN (3, 4) OR rule_id = 'local/mail'))
SELECT regex AS pattern, count(*) AS n_searches FROM m GROUP BY regex""")
def h6_shared_searches(spark, sf_dir):
    """How often each pattern runs: once for each file that misses, however many rules want it."""
    run = incremental.searches(_keyed_rules(spark), corpus(spark, sf_dir), _stored_results(spark, sf_dir))
    forms = _small(compile_rules(_keyed_rules(spark)).select("java", F.col("regex").alias("pattern")).distinct())
    return run.join(forms, "java").groupBy("pattern").agg(F.count("*").alias("n_searches"))


@query(f"WITH {MATCHES} SELECT rule_id, path, code, start_byte, end_byte FROM found")
def h7_check_stream(spark, sf_dir):
    from corpusward.streaming.check_stream import check_stream

    folder = shared_folder(spark, "stream")
    docs = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("pathGlobFilter", "*.parquet").parquet(sf_dir_glob(sf_dir))
    from .base import doc_path

    arriving = docs.select(doc_path().alias("path"), "text")
    check_stream(_keyed_rules(spark), arriving, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    stored = incremental.read_store(spark, f"{folder}/store")
    return stored.where("code is not null").select("rule_id", "path", "code", "start_byte", "end_byte")


def sf_dir_glob(sf_dir: str) -> str:
    """The documents table as a path that a file stream reads: a folder, or one file by a glob."""
    return f"{sf_dir}/documents.parquet*"


@query("""WITH d AS (SELECT DISTINCT sha256(text) AS h FROM documents), p AS (SELECT h, lag(h) OVER (ORDER BY h) AS q FROM d),
c AS (SELECT max(n) AS longest FROM (SELECT (SELECT max(k) FROM range(0, 65) r(k) WHERE left(h, k) = left(q, k)) AS n FROM p WHERE q IS NOT NULL))
SELECT CAST(greatest(8, longest + 1) AS BIGINT) AS prefix_length FROM c""")
def h8_short_prefix(spark, sf_dir):
    return findings.short_prefix(table(spark, sf_dir, "documents").select(text_digest(F.col("text")).alias("finding_id")))


@query("""WITH d AS (SELECT DISTINCT 'sha256:' || sha256(text) AS id FROM documents), w AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN left(sha256(text), 12) WHEN 1 THEN 'sha256:' || sha256(text) WHEN 2 THEN left(sha256(text), 5) ELSE reverse(left(sha256(text), 10)) END AS wanted FROM documents),
m AS (SELECT wanted, count(id) AS n, min(id) AS one FROM w LEFT JOIN d ON length(replace(wanted, 'sha256:', '')) >= 8 AND starts_with(replace(id, 'sha256:', ''), replace(wanted, 'sha256:', '')) GROUP BY wanted)
SELECT wanted, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, n AS n_candidates, CASE WHEN n = 1 THEN one END AS finding_id FROM m""")
def h9_resolve_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    h, k = F.sha2("text", 256), F.col("doc_id") % 4
    wanted = F.when(k == 0, F.substring(h, 1, 12)).when(k == 1, F.concat(F.lit("sha256:"), h)).when(k == 2, F.substring(h, 1, 5)).otherwise(F.reverse(F.substring(h, 1, 10)))
    return findings.resolve_prefix(docs.select(text_digest(F.col("text")).alias("finding_id")), docs.select(wanted.alias("wanted")))


def _number(spark=None):
    return F.regexp_extract("path", "([0-9]+)[.]txt", 1).cast("long")


def history(f):
    """A ledger that the findings imply: by document number, a first record and for some a second."""
    n = _number()
    decision = F.when(n % 4 == 0, "acceptable").when(n % 4 == 1, "confirmed_issue").when(n % 4 == 2, "accepted_risk").otherwise("needs_review")
    stale = lambda c, k, m: F.when(n % m == k, text_digest(F.concat(F.lit("old "), F.col(c)))).otherwise(F.col(c))
    watched = F.when(n % 3 == 0, F.create_map(F.col("path"), F.col("file_digest"), F.lit("gone.txt"), F.lit("sha256:0"))).when(n % 3 == 1, F.create_map(F.col("path"), text_digest(F.lit("old")))).otherwise(F.create_map().cast("map<string,string>"))
    base = f.where(n % 5 != 4).dropDuplicates(["finding_id"]).withColumns({"decision": decision, "rationale": F.lit("seen"), "revision": F.lit(1), "previous": F.lit(None).cast("string")})
    base = base.withColumns({"rule_digest": stale("rule_digest", 1, 6), "file_digest": stale("file_digest", 2, 7), "watched_files": watched})
    first = ledger.record_digest(base)
    second = ledger.record_digest(first.where(n % 2 == 0).withColumns({"revision": F.lit(2), "previous": F.col("record_digest"), "rationale": F.when(n % 8 == 0, F.lit(" ")).otherwise(F.lit("again"))}).drop("record_digest"))
    fields = [*ledger._RECORD_FIELDS, "rationale", "record_digest"]
    return first.select(*fields).unionByName(second.select(*fields))


_N = "CAST(regexp_extract(path, '([0-9]+)[.]txt', 1) AS BIGINT)"
#: The same ledger for DuckDB, last revisions only, without record digests.
LEDGER = f"""{FOUND}, led AS (SELECT DISTINCT finding_id, rule_id, path, kind, {_N} AS n, CASE WHEN {_N} % 2 = 0 THEN 2 ELSE 1 END AS revision, {_N} % 6 = 1 AS rule_changed, {_N} % 7 = 2 AS file_changed,
  CASE {_N} % 4 WHEN 0 THEN 'acceptable' WHEN 1 THEN 'confirmed_issue' WHEN 2 THEN 'accepted_risk' ELSE 'needs_review' END AS decision FROM ids WHERE {_N} % 5 <> 4)"""
_REASONS = """concat_ws(',', CASE WHEN rule_changed THEN 'rule_package_changed' END, CASE WHEN file_changed THEN 'owner_file_changed' END,
  CASE WHEN n % 3 = 0 THEN 'watched_file_missing:gone.txt' WHEN n % 3 = 1 THEN 'watched_file_changed:' || path END, CASE WHEN decision = 'acceptable' AND kind <> 'review' THEN 'acceptable_requires_review_diagnostic' END)"""
DISPOSED = f"""{LEDGER}, dis AS (SELECT i.finding_id, i.rule_id, i.path, i.kind, i.mode, i.start_byte, coalesce(l.decision, 'needs_review') AS decision, l.revision, CASE WHEN l.finding_id IS NULL THEN '' ELSE l.reasons END AS reasons,
  CASE WHEN l.finding_id IS NULL THEN 'unreviewed' WHEN l.reasons <> '' THEN 'stale' ELSE 'current' END AS validity
  FROM ids i LEFT JOIN (SELECT *, {_REASONS} AS reasons FROM led) l USING (finding_id)),
disposed AS (SELECT *, CASE WHEN validity = 'current' AND decision IN ('acceptable', 'accepted_risk') THEN 'accepted' WHEN validity = 'current' AND decision = 'confirmed_issue' THEN 'confirmed_issue' WHEN validity = 'stale' OR kind = 'review' THEN 'needs_review' ELSE 'violation' END AS status FROM dis)"""


def disposed(spark, sf_dir):
    f = found_once(spark, sf_dir)
    latest = written(ledger.latest_decisions(history(f)), "latest")
    watched = ledger.watched_state(latest, with_digest(corpus(spark, sf_dir)))
    return ledger.disposition(f, latest, watched), latest


@query(f"""WITH {LEDGER} SELECT finding_id, revision::INTEGER AS revision, problem FROM (
  SELECT finding_id, r.revision, CASE WHEN n % 8 = 0 AND r.revision = 2 THEN 'empty_rationale' END AS a, CASE WHEN rule_changed OR file_changed THEN 'evidence_mismatch' END AS b FROM led, (VALUES (1), (2)) r(revision) WHERE r.revision <= led.revision) UNPIVOT (problem FOR name IN (a, b))""")
def i1_validate_ledger(spark, sf_dir):
    return ledger.validate_ledger(history(found_once(spark, sf_dir)))


@query(f"SELECT doc_id, {digest_sql('WT-REVIEW-RECORD-1', 'text', 'source')} AS record_digest FROM documents")
def i2_record_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ledger.record_digest_of(F.col("text"), F.col("source")).alias("record_digest"))


@query(f"WITH {LEDGER} SELECT finding_id, decision, revision::INTEGER AS revision FROM led")
def i3_latest_decisions(spark, sf_dir):
    return ledger.latest_decisions(history(found_once(spark, sf_dir))).select("finding_id", "decision", "revision")


@query(f"WITH {LEDGER} SELECT finding_id, CASE WHEN n % 3 = 0 THEN 'watched_file_missing:gone.txt' ELSE 'watched_file_changed:' || path END AS reasons FROM led WHERE n % 3 <> 2")
def i4_watched_state(spark, sf_dir):
    latest = ledger.latest_decisions(history(found_once(spark, sf_dir)))
    return ledger.watched_state(latest, with_digest(corpus(spark, sf_dir))).select("finding_id", F.array_join("watched_reasons", ",").alias("reasons"))


@query(f"WITH {DISPOSED} SELECT finding_id, start_byte, decision, validity, reasons FROM disposed")
def i5_disposition(spark, sf_dir):
    return disposed(spark, sf_dir)[0].select("finding_id", "start_byte", "decision", "validity", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {DISPOSED} SELECT status, validity, kind, count(*) AS n FROM disposed GROUP BY ALL")
def i6_status(spark, sf_dir):
    return disposed(spark, sf_dir)[0].groupBy("status", "validity", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {DISPOSED} SELECT finding_id, CASE WHEN status = 'accepted' THEN 'reviewed' ELSE 'actionable' END AS part, status <> 'accepted' AND mode = 'enforced' AS blocking FROM disposed")
def i7_partition_findings(spark, sf_dir):
    actionable, reviewed = ledger.partition_findings(disposed(spark, sf_dir)[0])
    part = lambda d, v: d.select("finding_id", F.lit(v).alias("part"), "blocking")
    return part(actionable, "actionable").unionByName(part(reviewed, "reviewed"))


@query(f"WITH {DISPOSED} SELECT l.finding_id, l.decision, l.revision::INTEGER AS revision, CASE WHEN l.path LIKE 'src1/%' THEN 'not_observed' ELSE d.validity END AS validity FROM led l JOIN disposed d USING (finding_id)")
def i8_review_records(spark, sf_dir):
    d, latest = disposed(spark, sf_dir)
    return ledger.review_records(d.where("path not like 'src1/%'"), latest)


@query(f"WITH {FOUND} SELECT finding_id, 2::BIGINT AS n FROM ids WHERE path LIKE 'src2/%'")
def i9_duplicate_identities(spark, sf_dir):
    f = found_once(spark, sf_dir).select("finding_id", "path")
    return ledger.duplicate_identities(f.unionByName(f.where("path like 'src2/%'")))


def _requests(spark, sf_dir):
    """Requests on all findings, faulty in different ways by document number."""
    f = found_once(spark, sf_dir)
    latest = ledger.latest_decisions(history(f))
    n = _number()
    f_with = f.join(latest.select("finding_id", F.col("record_digest").alias("prior")), "finding_id", "left")
    rows = f_with.select(
        "finding_id", F.when(n % 3 == 0, "acceptable").otherwise("accepted_risk").alias("decision"), F.when(n % 11 == 1, " ").otherwise("because").alias("rationale"),
        F.when(n % 11 == 2, "sha256:0").otherwise(F.col("evidence_digest")).alias("evidence_digest"), F.when(n % 11 == 3, "sha256:1").otherwise(F.col("prior")).alias("expected_previous"),
        F.create_map(F.col("path"), F.when(n % 11 == 4, "sha256:2").otherwise(F.col("file_digest"))).alias("watched_files"), (n % 11).alias("k"),
    )
    twice = rows.where("k = 5")
    return rows.unionByName(twice).drop("k"), latest, f


@query(f"""WITH {LEDGER}, r AS (SELECT i.finding_id, i.kind, {_N.replace('path', 'i.path')} AS n, CASE WHEN l.finding_id IS NULL THEN 1 ELSE l.revision + 1 END AS revision FROM ids i LEFT JOIN led l USING (finding_id))
SELECT finding_id, revision::INTEGER AS revision, CASE WHEN n % 11 = 5 THEN 'duplicate_request' WHEN n % 11 = 2 THEN 'evidence_changed' WHEN n % 3 = 0 AND kind <> 'review' THEN 'acceptable_requires_review_diagnostic' WHEN n % 11 = 1 THEN 'empty_rationale' WHEN n % 11 = 3 THEN 'previous_record_changed' WHEN n % 11 = 4 THEN 'watched_file_changed' END AS reject_reason
FROM r, (VALUES (1), (2)) t(copy) WHERE copy = 1 OR n % 11 = 5""")
def i10_append_decisions(spark, sf_dir):
    requests, latest, f = _requests(spark, sf_dir)
    judged = ledger.judge_requests(latest, requests, f, with_digest(corpus(spark, sf_dir)))
    return judged.select("finding_id", "revision", "reject_reason")


@query(f"WITH {LEDGER} SELECT finding_id, left(replace(finding_id, 'sha256:', ''), 12) AS prefix, decision, revision::INTEGER AS revision, 'not_evaluated' AS validity FROM led")
def i11_list_reviews(spark, sf_dir):
    return ledger.list_reviews(history(found_once(spark, sf_dir)))


@query(f"""WITH {DISPOSED} SELECT finding_id, 'present' AS observation, path, status, validity, CASE WHEN validity <> 'unreviewed' THEN decision END AS decision, revision::INTEGER AS revision, reasons FROM disposed WHERE rule_id = 'local/address'
UNION ALL SELECT DISTINCT 'sha256:' || sha256(path), 'not_observed', NULL, NULL, NULL, NULL, NULL, NULL FROM disposed WHERE rule_id = 'local/mail'""")
def i12_inspect(spark, sf_dir):
    d, latest = disposed(spark, sf_dir)
    wanted = d.where("rule_id = 'local/address'").select("finding_id").unionByName(d.where("rule_id = 'local/mail'").select(text_digest(F.col("path")).alias("finding_id")))
    return ledger.inspect(wanted, d, latest).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {CORPUS_SQL}, o AS (SELECT path, doc_id, CASE WHEN doc_id % 7 = 1 THEN text || chr(10) || 'old line' ELSE text END AS text FROM corpus WHERE doc_id % 7 <> 3)
SELECT path, 'removed' AS change, 'old line' AS text, 1::BIGINT AS n FROM o WHERE doc_id % 7 = 1
UNION ALL SELECT path, 'previous_content_unavailable', NULL, NULL FROM corpus WHERE doc_id % 7 IN (2, 3)""")
def i13_line_diff(spark, sf_dir):
    from .sources import _old

    old, new = _old(spark, sf_dir), corpus(spark, sf_dir)
    n = _number()
    now = with_digest(new).join(with_digest(old).select("path", F.col("file_digest").alias("then")), "path", "left")
    decided = now.select("path", F.when(n % 7 == 2, "sha256:0").otherwise(F.coalesce("then", F.lit("sha256:1"))).alias("file_digest"))
    return ledger.line_diff(old, new, decided)


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), F.col("text").cast("binary").alias("content"))


def _run(spark, sf_dir, store=None, decisions=None):
    rows = rule_rows(spark, enabled=False).join(_small(execution_digests(rules(spark, enabled=False))), "rule_id")
    return check(rows, diagnostics(spark), _files(spark, sf_dir), store=store, decisions=decisions, max_bytes=100_000, per_rule_file=3)


#: What the plan checks: files of up to 100,000 bytes, rules that run, at most 3 findings of a rule in a file.
_CHECKED = f"""{CORPUS_SQL}, {RULES_SQL}, ran AS (SELECT * FROM rules WHERE mode <> 'disabled' AND rule_id <> 'global/insult' AND (rule_id <> 'local/token' OR EXISTS (SELECT 1 FROM corpus WHERE path = 'src0/fr/0.txt'))),
pairs AS (SELECT rule_id, path, text, regex, needle, code, most, kind, severity, mode FROM corpus, ran WHERE strlen(text) <= 100000 AND {SCOPE_SQL}),
every AS ({spans_sql('rule_id, path, code, kind, severity, mode', 'pairs')}), full_ AS (SELECT rule_id, path FROM every GROUP BY ALL HAVING count(*) > 3), kept AS (SELECT * FROM every ANTI JOIN full_ USING (rule_id, path))"""


@query(f"""WITH {_CHECKED}, x AS (SELECT k.*, decode(encode(c.text)[1:k.start_byte]) AS before, {_ENGINE} AS engine_digest, 'sha256:' || sha256(k.text) AS matched_digest FROM kept k JOIN corpus c USING (path))
SELECT {digest_sql('WT-FINDING-1', _ID_JSON)} AS finding_id, rule_id, path, code, start_byte, end_byte, CAST(len(string_split(before, chr(10))) AS BIGINT) AS start_line, CAST(length(string_split(before, chr(10))[-1]) + 1 AS BIGINT) AS start_column, kind, mode = 'enforced' AS blocking, 'unreviewed' AS validity, CASE WHEN kind = 'review' THEN 'needs_review' ELSE 'violation' END AS status FROM x""")
def p1_check_findings(spark, sf_dir):
    return _run(spark, sf_dir).findings.select("finding_id", "rule_id", "path", "code", "start_byte", "end_byte", "start_line", "start_column", "kind", "blocking", "validity", "status")


@query(f"WITH {_CHECKED} SELECT rule_id, path, 'diagnostic_limit' AS error FROM full_")
def p2_check_errors(spark, sf_dir):
    return _run(spark, sf_dir).errors


@query(f"""WITH {_CHECKED}, s AS (SELECT count(*) AS raw_findings, 0::BIGINT AS reviewed, count(*) AS actionable, count_if(mode = 'enforced')::BIGINT AS blocking, (SELECT count_if(strlen(text) <= 100000)::BIGINT FROM corpus) AS checked_files, (SELECT count_if(strlen(text) > 100000)::BIGINT FROM corpus) AS gaps, (SELECT count(*) FROM full_) AS n_errors FROM kept)
SELECT raw_findings, reviewed, actionable, blocking, checked_files, gaps, n_errors = 0 AND gaps = 0 AND checked_files > 0 AS complete, CASE WHEN NOT (n_errors = 0 AND gaps = 0 AND checked_files > 0) THEN 2 WHEN blocking > 0 THEN 1 ELSE 0 END AS exit_code FROM s""")
def p3_check_outcome(spark, sf_dir):
    ran = _run(spark, sf_dir)
    return ran.summary.select("raw_findings", "reviewed", "actionable", "blocking", "checked_files", "gaps").crossJoin(ran.outcome.select("complete", "exit_code"))  # one row each


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, pairs AS (SELECT rule_id, path FROM corpus, rules WHERE mode <> 'disabled' AND rule_id <> 'global/insult' AND strlen(text) <= 100000 AND {SCOPE_SQL}), n AS (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.]txt', 1) AS BIGINT) AS k FROM pairs), r(run, changed, added) AS (VALUES ('first', NULL, NULL), ('again', FALSE, FALSE), ('one file changed', TRUE, FALSE), ('one rule added', FALSE, TRUE))
SELECT run, CAST(count_if(CASE run WHEN 'first' THEN FALSE WHEN 'again' THEN TRUE WHEN 'one file changed' THEN k <> 7 ELSE rule_id <> 'local/mail' END) AS BIGINT) AS hits, CAST(count_if(CASE run WHEN 'first' THEN rule_id <> 'local/mail' WHEN 'again' THEN FALSE WHEN 'one file changed' THEN k = 7 ELSE rule_id = 'local/mail' END) AS BIGINT) AS misses
FROM n, r WHERE run = 'one rule added' OR rule_id <> 'local/mail' GROUP BY run""")
def p4_check_hits(spark, sf_dir):
    """Hits and misses of a first run, an unchanged one, one with a file changed and one with a rule added."""
    rows, files = rule_rows(spark).where("rule_id != 'global/insult'").join(_small(execution_digests(rules(spark))), "rule_id"), corpus(spark, sf_dir).where("octet_length(text) <= 100000")
    few = rows.where("rule_id != 'local/mail'")
    changed = files.withColumn("text", F.when(_number() == 7, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    one = incremental.check_incremental(few, files, spark.createDataFrame([], incremental.STORE))
    runs = {"first": one, "again": incremental.check_incremental(few, files, one[1]), "one file changed": incremental.check_incremental(few, changed, one[1]), "one rule added": incremental.check_incremental(rows, files, one[1])}
    totals = [c.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).select(F.lit(name).alias("run"), "hits", "misses") for name, (_, _, c) in runs.items()]
    return totals[0].unionByName(totals[1]).unionByName(totals[2]).unionByName(totals[3])


__all__ = ["spans_sql"]
