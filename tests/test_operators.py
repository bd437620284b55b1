"""Spans, detection, ledger, reports, fixtures and increments on small cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusward.functions.digest import CONTEXT, with_digest
from corpusward.operators import detect, findings, fixtures, ledger, markup, patterns, records, report, scope, spans
from corpusward.plans import check, incremental
from corpusward.sources import corpus as source
from corpusward.sources import selection

SPAN = "path string, start_byte long, end_byte long"
RULE = "rule_id string, code string, regex string, needle string, include_re string, exclude_re string, execution_digest string"


def rule(spark, *rows):
    return spark.createDataFrame([(*r, "^", "(?!)", f"e-{r[0]}-{r[2]}") for r in rows], RULE)


def corpus(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_containment(spark):
    outer = spark.createDataFrame([("p", 0, 10), ("p", 20, 30)], SPAN)
    inner = spark.createDataFrame([("p", 0, 10), ("p", 10, 12), ("p", 22, 25), ("q", 1, 2)], SPAN)
    assert sorted((x.start_byte, x.end_byte) for x in spans.inside(inner, outer).collect()) == [(0, 10), (22, 25)]
    assert sorted((x.path, x.start_byte) for x in spans.outside(inner, outer).collect()) == [("p", 10), ("q", 1)]
    assert spans.without_inner(outer, inner.where("start_byte = 22")).first().start_byte == 0
    assert spans.span_contains(outer, inner).count() == 2


def test_nested_elements_and_gaps(spark):
    df = spark.createDataFrame([("p", "<ul><li>a<ul><li>b</li></ul></li><li>c</ul>")], "path string, text string")
    got = [(r.start_byte, r.end_byte) for r in markup.elements(df, "li").orderBy("start_byte").collect()]
    assert got == [(4, 33), (13, 23)]
    assert markup.structure_gaps(df, ["ul", "li"]).first().unclosed == "li"


def test_records(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1},"c":[1,"x"]}'), (2, "{"), (3, None), (4, "[]")], "id int, body string")
    r = records.parse_records(df, "body")
    assert {x.id: x.reason for x in r.collect()} == {1: None, 2: "parse_error", 3: None, 4: None}
    assert r.where("id = 1").select(records.get(F.col("record"), "a", "b", as_type="long").alias("v")).first().v == 1
    assert sorted(x.key for x in records.entries(r, "record").collect()) == ["a", "c"]
    assert records.items(r, "record").count() == 0


def test_classification_order(spark):
    rows = [("a", b"ok"), ("b", b"\x00" + b"x" * 30), ("c", b"x" * 30), ("d", b"\xff"), ("e", b"x" * 9000 + b"\x00")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.status, r.reason) for r in source.classify(df, 20).collect()}
    assert got == {"a": ("checked", None), "b": ("binary", "nul_byte"), "c": ("gap", "oversized"), "d": ("gap", "invalid_utf8"), "e": ("gap", "oversized")}
    assert {r.path: r.reason for r in source.classify(df, 10_000).collect()}["e"] == "nul_byte"


def test_selection(spark):
    df = spark.createDataFrame([("a/x.txt", 5), ("a/y.txt", 5), ("b/.z", 5), ("b/c", 5)], "path string, n_bytes long")
    assert [r.path for r in selection.hidden_filter(df).orderBy("path").collect()] == ["a/x.txt", "a/y.txt", "b/c"]
    tracked = spark.createDataFrame([("a/x.txt",)], "path string")
    got = {r.path: r.is_ignored for r in selection.apply_ignore(df, [("**", False), ("b/**", True)], tracked).collect()}
    assert got == {"a/x.txt": False, "a/y.txt": True, "b/.z": False, "b/c": False}
    first = {r.path: r.reason for r in selection.apply_exclusions(df, [("a/*", "one"), ("**", "two")]).collect()}
    assert first["a/x.txt"] == "one" and first["b/c"] == "two"
    quota = {r.path: r.reason for r in selection.cumulative_quota(df, 3, 12).collect()}
    assert quota == {"a/x.txt": None, "a/y.txt": None, "b/.z": "source_snapshot_limit", "b/c": "source_snapshot_limit"}


@pytest.mark.parametrize("seed", range(4))
def test_quota_equals_one_pass_in_order(spark, seed):
    rng = random.Random(seed)
    sizes = [(f"f{k:03d}", rng.choice([rng.randint(0, 20), rng.randint(0, 200)])) for k in range(120)]
    max_files, max_bytes = rng.choice([(10, 2000), (200, 600), (40, 900), (0, 5)])
    want, files, size = {}, 0, 0
    for path, n in sizes:
        over = "source_file_limit" if files >= max_files else "source_snapshot_limit" if size + n > max_bytes else None
        files, size = (files, size) if over else (files + 1, size + n)
        want[path] = over
    df = spark.createDataFrame(sizes, "path string, n_bytes long")
    assert {r.path: r.reason for r in selection.cumulative_quota(df, max_files, max_bytes, block_rows=30).collect()} == want


def test_shared_request_pair(spark):
    rules = rule(spark, ("a", "hit", 'request\\("[a-z0-9]+"\\)', "foo"), ("b", "hit", 'request\\("[a-z0-9]+"\\)', "foo123"))
    both = corpus(spark, p='request("foo123")')
    assert sorted(r.rule_id for r in detect.detect_each_where(rules, both).collect()) == ["a", "b"]
    assert [r.rule_id for r in detect.detect_each_where(rules, corpus(spark, p='request("foo") // foo123')).collect()] == ["a"]
    one, two = detect.shared_evaluation(rules, both), detect.shared_evaluation(rules, both, shared=False)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_patterns_are_in_the_rule_language(spark):
    flags = "case_insensitive boolean, multi_line boolean"
    rows = [("empty", "b*", False, False), ("unicode", "\\w+", False, False), ("named", "(?P<k>a)", False, False), ("end", "x$", False, False), ("any case", "ABBA", True, False), ("lines", "^x$", False, True), ("broken", "(a", False, False), ("look", "(?=a)", False, False)]
    rules = spark.createDataFrame([(i, "hit", p, "^", "(?!)", a, m) for i, p, a, m in rows], f"rule_id string, code string, regex string, include_re string, exclude_re string, {flags}")
    docs = corpus(spark, p="abba é\nx", q="x\n")
    got = {}
    for r in detect.detect_each(rules, docs).collect():
        got.setdefault((r.rule_id, r.path), []).append((r.start_byte, r.end_byte))
    assert sorted(got["empty", "p"]) == [(0, 0), (1, 3), (4, 4), (5, 5), (7, 7), (8, 8), (9, 9)]
    assert sorted(got["unicode", "p"]) == [(0, 4), (5, 7), (8, 9)] and sorted(got["named", "p"]) == [(0, 1), (3, 4)]
    assert got["end", "p"] == [(8, 9)] and ("end", "q") not in got and got["any case", "p"] == [(0, 4)] and got["lines", "p"] == [(8, 9)] and got["lines", "q"] == [(0, 1)]
    assert {(r.rule_id, r.error) for r in detect.pattern_errors(rules).collect()} == {("broken", "invalid_pattern"), ("look", "invalid_pattern")}
    lone = detect.shared_evaluation(rules, docs, shared=False)
    assert sorted(map(tuple, detect.shared_evaluation(rules, docs).collect())) == sorted(map(tuple, lone.collect()))
    assert {(r.rule_id, r.path) for r in detect.detect_lines(rules.where("rule_id = 'end'"), docs).collect()} == {("end", "p"), ("end", "q")}


def test_several_patterns_and_codes_of_a_rule(spark):
    rules = rule(spark, ("a", "one", "x", "x"), ("a", "two", "y", "y"), ("a", "three", "x", "x"))
    got = sorted((r.code, r.start_byte) for r in detect.detect_each(rules, corpus(spark, p="xy")).collect())
    assert got == [("one", 0), ("three", 0), ("two", 1)]


def test_places_from_the_scan_equal_places_by_join(spark):
    rules = rule(spark, ("a", "hit", "[a-zé]+\n?[a-z]?", "x"), ("b", "hit", "z*", "x"))
    docs = corpus(spark, p="é ab\ncd ef\n\ngh", q="one line", r="\n\nx\n")
    one = detect.detect_located(rules, docs)
    raw = detect.detect_each(rules, docs)
    two = findings.with_matched_digest(findings.add_snippet(findings.add_coordinates(raw, docs), docs), docs)
    columns = sorted(one.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(one) == rows(two) and len(rows(one)) > 20


def test_absence_and_limits(spark):
    rules = rule(spark, ("a", "hit", "x", "x"))
    docs = corpus(spark, p="é", q="xx")
    row = detect.detect_absence(rules, docs).first()
    assert (row.path, row.start_byte, row.end_byte) == ("p", 0, 2)
    kept, errors = detect.enforce_limits(detect.detect_each(rules, docs), 1)
    assert kept.count() == 0 and errors.first().path == "q"


def test_increments_count_as_expected(spark):
    docs = corpus(spark, **{f"d{k}": f"text x{k}" for k in range(6)})
    rules = rule(spark, *[(f"r{k}", "hit", f"x{k}", "x") for k in range(4)])
    empty = spark.createDataFrame([], incremental.STORE)
    total = lambda c: tuple(c.agg(F.sum("hits"), F.sum("misses")).first())
    found, store, counts = incremental.check_incremental(rules, docs, empty)
    assert total(counts) == (0, 24) and found.count() == 4
    assert total(incremental.check_incremental(rules, docs, store)[2]) == (24, 0)
    changed = docs.withColumn("text", F.when(F.col("path") == "d1", "other").otherwise(F.col("text")))
    again, _, counts = incremental.check_incremental(rules, changed, store)
    assert total(counts) == (20, 4) and again.count() == 3
    more = rules.unionByName(rule(spark, ("new", "hit", "text", "x")))
    assert total(incremental.check_incremental(more, docs, store)[2]) == (24, 6)
    spoiled = store.withColumn("end_byte", F.when(F.col("start_byte").isNotNull(), 10**6))
    assert total(incremental.check_incremental(rules, docs, spoiled)[2]) == (20, 4)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_sweeps_equal_all_pairs(spark, block):
    """Random spans, many of them equal, nested, crossing or empty, against every pair."""
    rng = random.Random(block)
    make = lambda n: [(rng.choice(["p", "q", None]), s, s + rng.choice([0, 1, 2, 5, 9, 40]), k) for k in range(n) for s in [rng.randrange(60)]]
    schema = "path string, start_byte long, end_byte long, _at long"  # the last name clashes with an inner one
    for n, m in ((80, 40), (200, 5), (3, 0), (0, 3)):
        a, b = make(n), make(m)
        inner, outer = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
        holds = lambda o, i: o[0] is not None and o[0] == i[0] and i[1] >= o[1] and i[2] <= o[2]
        rows = lambda df: sorted(map(str, map(tuple, df.select("path", "start_byte", "end_byte", "_at").collect())))
        assert rows(spans.inside(inner, outer, block=block)) == sorted(str(i) for i in a if any(holds(o, i) for o in b))
        assert rows(spans.outside(inner, outer, block=block)) == sorted(str(i) for i in a if not any(holds(o, i) for o in b))
        assert rows(spans.without_inner(outer, inner, block=block)) == sorted(str(o) for o in b if not any(holds(o, i) for i in a))
        want = sorted((i[3], *max((o[1], -o[2]) for o in b if holds(o, i))) for i in a if any(holds(o, i) for o in b))
        assert sorted((r._at, r.outer_start, -r.outer_end) for r in spans.innermost(inner, outer).collect()) == want


def test_spans_of_a_file_meet_however_their_partitions_are_joined_up(spark):
    """Sides that come dealt by their files, one with more bytes than the other, so that fewer of its partitions go together."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        page = F.concat(F.lit("<ul><li>"), F.repeat(F.lit('<a href="/x">é</a>'), 20), F.lit("</li></ul>"))
        df = spark.range(1000).select(F.col("id").cast("string").alias("path"), page.alias("text"))
        links, items = markup.elements(df, "a"), markup.elements(df, "li")
        found = markup.match_in_context(links, items)
        assert found.count() == found.where("outer_start = 4").count() == 20_000
        assert spans.inside(links, items).count() == 20_000
        assert spans.outside(links, items).count() == spans.without_inner(items, links).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_file_with_very_many_spans(spark):
    """Half a million spans each side of one file, all in one large span: pairs would be 2.5e11."""
    n = 500_000
    inner = spark.range(n).select(F.lit("p").alias("path"), (F.col("id") * 10 + 3).alias("start_byte"), (F.col("id") * 10 + 5).alias("end_byte"))
    outer = spark.range(n).select(F.lit("p").alias("path"), (F.col("id") * 10).alias("start_byte"), (F.col("id") * 10 + 4 + F.col("id") % 2).alias("end_byte"))
    assert spans.inside(inner, outer).count() == n // 2
    assert spans.without_inner(outer, inner).count() == n // 2
    whole = outer.unionByName(spark.createDataFrame([("p", 0, 10 * n)], outer.schema))
    assert spans.outside(inner, whole).count() == 0
    assert spans.innermost(inner, whole).where("outer_start = 0").count() == n // 2


def test_misses_share_evaluations(spark):
    """Eight rules with one regex search each file once; files that hit are not searched."""
    docs = corpus(spark, **{f"d{k}": f"text x{k % 3}" for k in range(5)})
    rules = rule(spark, *[(f"r{k}", "hit", "x1", "x") for k in range(8)], ("z", "hit", "z*", "x"))
    empty = spark.createDataFrame([], incremental.STORE)
    assert incremental.searches(rules, docs, empty).count() == 10
    first, store, _ = incremental.check_incremental(rules, docs, empty)
    want = sorted((r.rule_id, r.path, r.code, r.start_byte, r.end_byte) for r in detect.detect_each(rules, docs).collect())
    rows = lambda df: sorted((r.rule_id, r.path, r.code, r.start_byte, r.end_byte) for r in df.collect())
    assert rows(first) == want
    assert incremental.searches(rules, docs, store).count() == 0
    changed = docs.where("path != 'd4'").unionByName(corpus(spark, d4="x1 x1", d5="x1"))
    assert incremental.searches(rules, changed, store).count() == 4
    second, fresh, counts = incremental.check_incremental(rules, changed, store)
    assert rows(second) == sorted((r.rule_id, r.path, r.code, r.start_byte, r.end_byte) for r in detect.detect_each(rules, changed).collect())
    assert tuple(counts.agg(F.sum("hits"), F.sum("misses")).first()) == (36, 18)
    assert fresh.where("code is null and (file_digest is not null or start_byte is not null)").count() == 0


def test_a_run_over_one_file_reads_its_bucket(spark, tmp_path):
    docs, rules = corpus(spark, **{f"d{k}": "text x1" for k in range(60)}), rule(spark, ("r", "hit", "x1", "x"))
    incremental.append_store(incremental.check_incremental(rules, docs, incremental.read_store(spark, f"{tmp_path}/s"))[1], f"{tmp_path}/s")
    store = incremental.read_store(spark, f"{tmp_path}/s")
    one = corpus(spark, d7="text x1")
    part = incremental.touched(store, one)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*bucket", plan) and 0 < part.count() < store.count() == 60
    assert len(part.select(F.input_file_name()).distinct().collect()) == 1
    assert incremental.check_incremental(rules, one, store)[2].first().hits == 1


def test_batches_are_stored_whole_or_not_at_all(spark, tmp_path):
    docs, rules = corpus(spark, d1="text x1", d2="x1 x1"), rule(spark, ("r", "hit", "x1", "x"))
    fresh = incremental.check_incremental(rules, docs, incremental.read_store(spark, f"{tmp_path}/s"))[1]
    fresh.where("path = 'd1'").write.parquet(f"{tmp_path}/s/batch-7")
    (tmp_path / "s/batch-7/_SUCCESS").unlink()  # a writer that was cut off
    assert incremental.read_store(spark, f"{tmp_path}/s").count() == 0
    incremental.append_store(fresh, f"{tmp_path}/s", "7")
    assert incremental.read_store(spark, f"{tmp_path}/s").count() == 3
    incremental.append_store(fresh.where("false"), f"{tmp_path}/s", "7")  # run again, it is left alone
    incremental.compact_store(spark, f"{tmp_path}/s", f"{tmp_path}/t")
    for path in ("s", "t"):
        found, _, counts = incremental.check_incremental(rules, docs, incremental.read_store(spark, f"{tmp_path}/{path}"))
        assert counts.first().hits == 2 and found.count() == 3 and {r.start_line for r in found.collect()} == {1}


def test_check_with_a_ledger_and_a_gap(spark):
    rules = rule(spark, ("r", "hit", "x1", "x"), ("bad", "hit", "(x", "x")).withColumns({"mode": F.lit("enforced"), "severity": F.lit("error"), "require_files": F.array().cast("array<string>")})
    told = spark.createDataFrame([("r", "hit", "review", "m", "h")], "rule_id string, code string, kind string, message string, help string")
    files = spark.createDataFrame([("a", b"one x1"), ("b", b"x1\nx1"), ("c", b"\xff"), ("d", b"\x00")], "path string, content binary")
    first = check.check(rules, told, files)
    assert {(r.path, r.start_line, r.status) for r in first.findings.collect()} == {("a", 1, "needs_review"), ("b", 1, "needs_review"), ("b", 2, "needs_review")}
    assert [tuple(r) for r in first.errors.collect()] == [("bad", None, "invalid_pattern")]
    assert first.outcome.first().exit_code == 2 and {(r.path, r.status) for r in first.coverage.collect()} == {("a", "checked"), ("b", "checked"), ("c", "gap"), ("d", "binary")}
    decided = first.findings.where("path = 'a'").withColumns({"decision": F.lit("acceptable"), "rationale": F.lit("fine"), "revision": F.lit(1), "previous": F.lit(None).cast("string"), "watched_files": F.create_map().cast("map<string,string>")})
    again = check.check(rules.where("rule_id = 'r'"), told, files.where("path < 'c'"), store=first.fresh, decisions=ledger.record_digest(decided))
    assert {(r.path, r.status) for r in again.findings.collect()} == {("a", "accepted"), ("b", "needs_review")}
    assert again.outcome.first().exit_code == 1 and again.hits.first().hits == 2


SIGNAL_CASES = [
    ("disabled", dict(mode="disabled", confirmed=1)), ("unknown", dict(complete=False)), ("useful", dict(confirmed=1, decided=1)), ("dead", dict(scoped=0)),
    ("watch", dict(intent="watch", raw=1)), ("quiet", dict()), ("noisy", dict(acceptable=2, decided=3)), ("active", dict(raw=1, acceptable=1, decided=2)),
]


@pytest.mark.parametrize(("label", "given"), SIGNAL_CASES)
def test_signals(spark, label, given):
    base = dict(mode="advisory", complete=True, intent="detect", scoped=5, raw=0, acceptable=0, confirmed=0, decided=0, open_=0) | given
    assert spark.range(1).select(report.signal(**{k: F.lit(v) for k, v in base.items()}).alias("s")).first().s == label


def test_expectation_statuses(spark):
    expect = spark.createDataFrame([(r, 2) for r in ("local/a", "local/b", "local/c", "local/d", "local/e", "local/f", "global/g")], "rule_id string, minimum_files long")
    summary = spark.createDataFrame([("local/a", "completed", 2), ("local/b", "completed", 1), ("local/c", "failed", 9), ("local/d", "disabled", 0), ("local/e", "not_applicable", 0), ("global/g", "completed", 3)], "rule_id string, status string, checked_files long")
    gaps = spark.createDataFrame([("global/g", 1)], "rule_id string, n_gaps long")
    got = {r.rule_id: r.status for r in report.coverage_expectations(expect, summary, gaps).collect()}
    assert got == {"local/a": "satisfied", "local/b": "insufficient_files", "local/c": "incomplete", "local/d": "disabled", "local/e": "not_applicable", "local/f": "missing_rule", "global/g": "incomplete"}
    assert {r.status for r in report.coverage_expectations(expect, summary, gaps, partial=True).collect()} == {"not_evaluated_partial"}
    assert {r.rule_id: r.status for r in report.coverage_expectations(expect, summary, gaps, omitted="global").collect()}["global/g"] == "missing_rule"


def _finding(spark, **over):
    base = dict(finding_id="f", kind="review", rule_digest="r", file_digest="d", context_digest="c", engine_digest="e", evidence_digest="v", path="p") | over
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))


def _record(spark, decision="acceptable", watched=None):
    return spark.createDataFrame([("f", 1, decision, "r", "d", "c", "e", "v", watched or {})], "finding_id string, revision int, decision string, rule_digest string, file_digest string, context_digest string, engine_digest string, evidence_digest string, watched_files map<string,string>")


@pytest.mark.parametrize(
    ("change", "decision", "watched", "status", "reasons"),
    [
        ({}, "acceptable", {}, "accepted", []), ({"finding_id": "copy"}, "acceptable", {}, "needs_review", []),
        ({}, "acceptable", {"w": "old"}, "needs_review", ["watched_file_changed:w"]), ({}, "acceptable", {"lost": "x"}, "needs_review", ["watched_file_missing:lost"]),
        ({"file_digest": "x", "context_digest": "y", "evidence_digest": "z"}, "acceptable", {}, "needs_review", ["owner_file_changed"]),
        ({"context_digest": "y", "evidence_digest": "z"}, "acceptable", {}, "needs_review", ["repository_input_inventory_changed"]),
        ({"evidence_digest": "z"}, "accepted_risk", {}, "needs_review", []), ({"kind": "violation"}, "acceptable", {}, "needs_review", ["acceptable_requires_review_diagnostic"]),
        ({}, "confirmed_issue", {}, "confirmed_issue", []), ({"kind": "violation"}, "needs_review", {}, "violation", []),
    ],
)
def test_disposition(spark, change, decision, watched, status, reasons):
    files = spark.createDataFrame([("w", "new")], "path string, file_digest string")
    record = _record(spark, decision, watched)
    got = ledger.disposition(_finding(spark, **change), record, ledger.watched_state(record, files)).first()
    assert (got.status, got.reasons) == (status, reasons)


def test_missing_findings_are_not_observed(spark):
    record = _record(spark)
    disposed = ledger.disposition(_finding(spark, finding_id="other"), record, ledger.watched_state(record, spark.createDataFrame([], "path string, file_digest string")))
    assert ledger.review_records(disposed, record).first().validity == "not_observed"


def test_fixture_multisets(spark):
    schema = "rule_id string, case_name string, path string, code string, kind string, start_byte long, end_byte long"
    actual = spark.createDataFrame([("r", "a", "p", "c", "k", 0, 1), ("r", "a", "p", "c", "k", 5, 6), ("r", "b", "p", "c", "k", 0, 1)], schema)
    cases = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "none")], "rule_id string, case_name string")
    expect = lambda *rows: spark.createDataFrame(list(rows), schema)
    ok = fixtures.compare_expected(actual, expect(("r", "a", "p", "c", "k", 5, 6), ("r", "a", "p", "c", "k", None, None), ("r", "b", "p", "c", "k", 0, 1)), cases)
    assert all(r.passed for r in ok.collect())
    bad = fixtures.compare_expected(actual, expect(("r", "a", "p", "c", "k", 5, 6), ("r", "a", "p", "c", "k", 5, 6), ("r", "b", "p", "c", "k", None, None)), cases)
    assert {r.case_name: r.passed for r in bad.collect()} == {"a": False, "b": True, "none": True}


def test_line_diff(spark):
    old, new = corpus(spark, p="a\nb\nb\n", q="x"), corpus(spark, p="a\nb\nc\n", q="y")
    decided = with_digest(old).select("path", F.when(F.col("path") == "q", "sha256:0").otherwise(F.col("file_digest")).alias("file_digest"))
    got = sorted((r.path, r.change, r.text, r.n) for r in ledger.line_diff(old, new, decided).collect() if r.text)
    assert got == [("p", "added", "c", 1), ("p", "removed", "b", 1)]


def test_plain_files_are_read_and_classified(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.bin").write_bytes(b"\x00x")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in source.classify(source.read_files(spark, str(tmp_path)), 100).collect()}
    assert got == {"a.txt": "checked", "b.bin": "binary"}


def test_decisions_append_and_validate(spark, tmp_path):
    from corpusward.functions.digest import text_digest
    from corpusward.operators.detect import detect_each
    from corpusward.operators.findings import add_identity, with_matched_digest

    docs = corpus(spark, p="xx", q="no")
    found = with_matched_digest(detect_each(rule(spark, ("r", "hit", "x", "x")), docs), docs).withColumn("kind", F.lit("review"))
    found = add_identity(found.withColumns({"rule_digest": text_digest(F.lit("r")), "engine_digest": text_digest(F.lit("e"))}))
    empty = ledger.record_digest(found.where("false").select("*", F.lit(1).alias("revision"), F.lit("").alias("decision"), F.lit("").alias("rationale"), F.lit(None).cast("string").alias("previous"), F.create_map().cast("map<string,string>").alias("watched_files")))
    requests = found.select("finding_id", F.lit("acceptable").alias("decision"), F.when(F.col("start_byte") == 0, "fine").otherwise(" ").alias("rationale"), "evidence_digest", F.lit(None).cast("string").alias("expected_previous"), F.create_map().cast("map<string,string>").alias("watched_files"))
    path = str(tmp_path / "ledger")
    accepted, rejected = ledger.append_decisions(empty, requests, found, with_digest(docs), path)
    assert [r.reject_reason for r in rejected.collect()] == ["empty_rationale"]
    stored = spark.read.parquet(path)
    assert stored.count() == 1 and ledger.validate_ledger(stored).count() == 0
    again = requests.where("rationale = 'fine'")
    assert ledger.append_decisions(stored, again, found, with_digest(docs))[1].first().reject_reason == "previous_record_changed"
    linked = again.drop("expected_previous").join(stored.select("finding_id", F.col("record_digest").alias("expected_previous")), "finding_id")
    second, none = ledger.append_decisions(stored, linked, found, with_digest(docs))
    assert none.count() == 0 and second.first().revision == 2
    broken = stored.withColumn("rationale", F.lit(""))
    assert {r.problem for r in ledger.validate_ledger(broken).collect()} == {"empty_rationale"}


def test_ledger_gaps_and_broken_links(spark):
    base = dict(decision="acceptable", rule_id="r", code="c", path="p", start_byte=0, end_byte=1, rationale="x", watched_files={})
    rows = [("f", 1, None, "sha256:" + "a" * 64), ("f", 3, "sha256:" + "b" * 64, "sha256:" + "c" * 64)]
    schema = "finding_id string, revision int, previous string, record_digest string"
    df = spark.createDataFrame(rows, schema).withColumns({k: F.create_map().cast("map<string,string>") if k == "watched_files" else F.lit(v) for k, v in base.items()})
    df = df.withColumns({c: F.lit("sha256:" + "0" * 64) for c in ("matched_digest", "rule_digest", "file_digest", "context_digest", "engine_digest", "evidence_digest")})
    got = {(r.revision, r.problem) for r in ledger.validate_ledger(df).collect()}
    assert {(3, "revision_gap"), (3, "broken_link"), (1, "malformed_digest"), (1, "identity_mismatch")} <= got


def test_prefixes(spark):
    from corpusward.operators.findings import resolve_prefix, short_prefix

    ids = spark.createDataFrame([("sha256:" + "ab" * 32,), ("sha256:" + "ab" * 5 + "cd" * 27,), ("sha256:" + "0" * 64,)], "finding_id string")
    assert short_prefix(ids).first().prefix_length == 11
    wanted = spark.createDataFrame([("ab" * 5,), ("ab" * 5 + "c",), ("0" * 7,), ("0" * 8,), ("sha256:" + "ab" * 32,), ("ff" * 8,)], "wanted string")
    got = {r.wanted: r.outcome for r in resolve_prefix(ids, wanted).collect()}
    assert [got[w.wanted] for w in wanted.collect()] == ["ambiguous", "resolved", "unmatched", "resolved", "resolved", "unmatched"]


@pytest.mark.parametrize("few", [True, False])
def test_scopes_are_looked_up_by_folders_and_suffixes(spark, monkeypatch, few):
    """Every kind of key against the patterns themselves, broadcast and shuffled."""
    from corpusward.functions.globs import any_glob_regex, lookup_keys

    if not few:
        monkeypatch.setattr(scope, "BROADCAST_SCOPES", 2)
    globs = {
        "a": ["src/**"], "b": ["src/a/*", "src/**"], "c": ["**/*.md"], "d": ["**/*.md", "*.txt"], "e": ["**"], "f": ["src/**", "**/*.txt"], "g": ["src/{a,b}/*.md"],
        "h": ["s[r]c/*"], "i": ["a.b/c+d/x.txt"], "j": ["src/a.txt", "docs/**"], "k": ["**/{x.md,y.txt}"], "l": ["we ird/(x)|/[!a]*"], "m": ["src/a/"], "n": ["README"],
    }
    keys = {k: lookup_keys(any_glob_regex(g)) for k, g in globs.items()}
    assert keys["a"] == keys["b"] == ["src/"] and keys["c"] == [".md"] and keys["d"] == [".md", ".txt"] and keys["g"] == ["src/"]
    assert keys["i"] == ["a.b/c+d/"] and keys["j"] == ["docs/", "src/"] and keys["l"] == ["we ird/(x)|/"] and all(keys[k] == [""] for k in "efhkn")
    assert lookup_keys("^src/.*") == lookup_keys("x") == [""] and lookup_keys("(?s)^(?:src/*x)\\z") == [""] and lookup_keys("(?s)^(?:a/b\\.?c)\\z") == ["a/"]
    paths = ["src/a/x.md", "src/x.txt", "src/b/y.md", "src", "README", "x.txt", "a.b/c+d/x.txt", "docs/x", "docs/a/b/x.md", "we ird/(x)|/b", "we ird/(x)|/a", ".md", "src/a/", "é/ü.md", "x.md\n", ""]
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)
    rows = [(k, any_glob_regex(g), any_glob_regex(["src/b/**"]) if k in "ab" else "(?!)") for k, g in globs.items()] + [("null", None, "(?!)"), ("same", any_glob_regex(["src/**"]), "(?!)"), ("twin", any_glob_regex(["src/**"]), "(?!)")]
    scopes = spark.createDataFrame(rows, "rule_id string, include_re string, exclude_re string")
    own = files.crossJoin(scopes).where(scope.in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re"))).select("rule_id", "path")
    ours = scope.scope_join(scopes, files)
    assert sorted(ours.collect()) == sorted(own.collect())
    keyed = scope.scope_join(scopes.where("rule_id in ('a', 'b', 'c', 'd', 'g', 'j')"), files)
    if few:
        assert not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(re.findall(r"\w+", keyed._jdf.queryExecution().toString()))
    assert scope.relevant_gaps(files, scopes.where("rule_id = 'c'").drop("rule_id")).count() == 5
    assert scope.scope_join(scopes.where("false"), files).count() == scope.scope_join(scopes, files.where("false")).count() == 0


@pytest.mark.parametrize("most", [100_000, 3])
def test_literal_hits(spark, monkeypatch, most):
    """Overlaps, repeats, the empty literal and nulls; in one pass and in several."""
    monkeypatch.setattr(patterns, "LITERALS", most)
    words = ["he", "she", "hers", "is", "", "é😀", "\n", "he", None, "absent", "ushers"]
    rows = [("a", 1, "ushers"), ("b", 2, ""), ("c", 3, None), ("d", 4, "é😀 this\nhe"), ("d", 4, "é😀 this\nhe"), (None, 5, "his" * 50_000)]
    df = spark.createDataFrame(rows, "path string, literal_no int, text string")
    literals = spark.createDataFrame([(w,) for w in words], "literal string")
    got = [tuple(r) for r in patterns.literal_hits(df, literals, ["path", "literal_no"]).collect()]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted([(p, n, w) for p, n, t in rows if t is not None for w in set(words) - {None} if w in t], key=key)
    assert patterns.literal_hits(df, literals.where("false")).count() == patterns.literal_hits(df.where("false"), literals).count() == 0


def test_calls_stop_beyond_their_limit(spark):
    rules = rule(spark, ("one", "hit", "ab", ""), ("twin", "hit", "ab", ""), ("other", "hit", "b$", ""), ("two", "hit", "a", ""), ("two", "more", "c", ""), ("empty", "hit", "x*", ""), ("broken", "hit", "(", ""))
    texts = corpus(spark, exact="ab" * 3, over="ab" * 4, mixed="aaaac", none="", long="ab" * 1_000_000)
    found, errors = detect.detect_each_within(rules, texts.where("path != 'long'").union(spark.createDataFrame([("null", None)], "path string, text string")), 3)
    assert sorted((r.rule_id, r.path) for r in errors.collect()) == [("empty", "exact"), ("empty", "mixed"), ("empty", "over"), ("one", "over"), ("twin", "over"), ("two", "mixed"), ("two", "over")]
    every = detect.detect_each(rules, texts.where("path != 'long'"))
    assert sorted(found.collect()) == sorted(detect.failed_invocations(every, errors).collect()) and found.where("rule_id = 'two'").count() == 3
    found, errors = detect.detect_each_within(rules.where("rule_id in ('one', 'other')"), texts)
    assert [(r.rule_id, r.path) for r in errors.collect()] == [("one", "long")]
    assert [(r.rule_id, r.start_byte) for r in found.where("path = 'long'").collect()] == [("other", 1_999_999)]


def test_context_digests_stream_in_the_order_of_paths(spark):
    """As the pinned form says, over many files and several rules; no list of a rule's files is made."""
    frame = lambda part: len(part.encode()).to_bytes(8, "big") + part.encode()
    files = {r: [(f"{r}/é{k * 7919 % 30_011}.txt", f"sha256:{k:064x}") for k in range(n)] for r, n in (("r/a", 1), ("r/b", 30_000), ("r/c", 50))}
    rows = [(r, *f) for r, own in files.items() for f in own]
    members = spark.createDataFrame([*rows, ("r/b", "gone", None), ("r/d", "gone", None)], "rule_id string, path string, file_digest string")
    want = {r: "sha256:" + hashlib.sha256(frame(CONTEXT) + b"".join(frame(p) + frame(d) for p, d in sorted(own, key=lambda f: f[0].encode()))).hexdigest() for r, own in files.items()}
    got = findings.context_digests(members)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert dict(map(tuple, got.collect())) == want | {"r/d": None}
    assert findings.context_digests(members.where("false")).count() == 0


def test_findings_of_a_pattern_fan_out_by_scope(spark):
    """Patterns of one scope and of several, native and stepped, and a scope that is null."""
    rows = [("r/one", "[0-9]*", "^a", "(?!)"), ("r/two", "x", "^a", "(?!)"), ("r/three", "x", "^b", "(?!)"), ("r/four", "y", "^", "^a"), ("r/five", "b*", "^a", "(?!)"), ("r/six", "b*", "^", "^a"), ("r/none", "z", None, "(?!)")]
    rules = spark.createDataFrame([(i, "c", *r) for i, *r in rows], "rule_id string, code string, regex string, include_re string, exclude_re string")
    found = detect.detect_each(rules, corpus(spark, a1="xyz", b1="xy", c1=None))
    got = {}
    for r in found.collect():
        got.setdefault((r.rule_id, r.path), []).append((r.start_byte, r.end_byte))
    places = lambda n: [(k, k) for k in range(n + 1)]
    assert {k: sorted(v) for k, v in got.items()} == {("r/one", "a1"): places(3), ("r/two", "a1"): [(0, 1)], ("r/three", "b1"): [(0, 1)], ("r/four", "b1"): [(1, 2)], ("r/five", "a1"): places(3), ("r/six", "b1"): places(2)}
    assert {r.regex: r.alone for r in detect._rows(rules, "regex").collect()} == {"[0-9]*": True, "x": False, "y": True, "b*": False, "z": True}
