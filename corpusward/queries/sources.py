"""Queries of sources, rule tables and scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions.digest import with_digest
from corpusward.functions.globs import glob_match, glob_regex
from corpusward.operators import scope
from corpusward.sources import corpus as source
from corpusward.sources import rules as rule_tables
from corpusward.sources import selection

from .base import CORPUS_SQL, RULES_SQL, SCOPE_SQL, corpus, doc_path, query, rule_rows, rules, table

_EXCLUDES = [("src1/**", "first"), ("src1?/en/*", "second"), ("**/1*.txt", "third")]
_IGNORE = [("**/*0.txt", False), ("src0/**", True), ("src0/en/*", False)]
_SIZED = "sized AS (SELECT path, text, strlen(text) AS n_bytes FROM corpus)"


@query(f"WITH {CORPUS_SQL} SELECT path, text, 'current' AS snapshot FROM corpus")
def a1_read_corpus(spark, sf_dir):
    return source.read_corpus(spark, f"{sf_dir}/documents.parquet", "concat_ws('/', source, lang, concat(doc_id, '.txt'))")


@query(f"WITH {CORPUS_SQL} SELECT path, 'sha256:' || sha256(text) AS file_digest, strlen(text) AS n_bytes FROM corpus")
def a2_with_digest(spark, sf_dir):
    return with_digest(corpus(spark, sf_dir)).drop("text")


def _content(spark, sf_dir):
    """documents as bytes, some with a NUL or with a broken encoding put in by their ids."""
    text, k = F.col("text").cast("binary"), F.col("doc_id") % 11
    content = F.when(k == 1, F.concat(F.lit(b"\x00"), text)).when(k == 2, F.concat(text, F.lit(b"\xff"))).when(k == 3, F.concat(text, F.lit(b"\x00"))).otherwise(text)
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), content.alias("content"))


@query(f"""WITH {CORPUS_SQL}, c AS (SELECT path, text, doc_id % 11 AS k, strlen(text) + CASE WHEN doc_id % 11 IN (1, 2, 3) THEN 1 ELSE 0 END AS n FROM corpus)
SELECT path, CAST(n AS BIGINT) AS n_bytes,
  CASE WHEN k = 1 OR k = 3 AND n <= 8192 THEN 'binary' WHEN n > 6000 THEN 'gap' WHEN k = 3 THEN 'binary' WHEN k = 2 THEN 'gap' ELSE 'checked' END AS status,
  CASE WHEN k = 1 OR k = 3 AND n <= 8192 THEN 'nul_byte' WHEN n > 6000 THEN 'oversized' WHEN k = 3 THEN 'nul_byte' WHEN k = 2 THEN 'invalid_utf8' END AS reason FROM c""")
def a3_classify(spark, sf_dir):
    return source.classify(_content(spark, sf_dir), 6000).drop("text")


@query(f"""WITH {CORPUS_SQL} SELECT path, CASE WHEN reason IS NULL THEN 'checked' ELSE 'excluded' END AS status, reason FROM (SELECT path,
  CASE WHEN regexp_matches(path, '^src1/') THEN 'first' WHEN regexp_matches(path, '^src1[^/]/en/[^/]*$') THEN 'second' WHEN regexp_matches(path, '/1[^/]*[.]txt$') THEN 'third' END AS reason FROM corpus)""")
def a4_apply_exclusions(spark, sf_dir):
    return selection.apply_exclusions(corpus(spark, sf_dir).select("path"), _EXCLUDES).select("path", "status", "reason")


@query(f"""WITH {CORPUS_SQL} SELECT path, (CASE WHEN path LIKE 'src0/en/%' THEN TRUE WHEN path LIKE 'src0/%' THEN FALSE WHEN path LIKE '%0.txt' THEN TRUE ELSE FALSE END) AND doc_id % 7 <> 0 AS is_ignored FROM corpus""")
def a5_apply_ignore(spark, sf_dir):
    tracked = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(doc_path().alias("path"))
    return selection.apply_ignore(corpus(spark, sf_dir).select("path"), _IGNORE, tracked)


@query(f"WITH {CORPUS_SQL} SELECT path FROM corpus WHERE path LIKE 'src1/%' OR path LIKE 'src2/en/%' OR path = 'src3/en/3.txt'")
def a6_select_paths(spark, sf_dir):
    return selection.select_paths(corpus(spark, sf_dir).select("path"), ["src1", "src2/en/", "src3/en/3.txt"])


@query(f"""WITH {CORPUS_SQL}, h AS (SELECT CASE WHEN doc_id % 5 = 0 THEN replace(path, '/en/', '/.en/') WHEN doc_id % 5 = 1 THEN '.' || path ELSE path END AS path FROM corpus)
SELECT path FROM h WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%'""")
def a7_hidden_filter(spark, sf_dir):
    k = F.col("doc_id") % 5
    path = F.when(k == 0, F.replace(doc_path(), F.lit("/en/"), F.lit("/.en/"))).when(k == 1, F.concat(F.lit("."), doc_path())).otherwise(doc_path())
    return selection.hidden_filter(table(spark, sf_dir, "documents").select(path.alias("path")))


def _old(spark, sf_dir):
    """An earlier snapshot: some documents absent, some of other content, some since removed."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    kept = docs.where(k != 3).select(doc_path().alias("path"), F.when(k == 1, F.concat("text", F.lit("\nold line"))).otherwise(F.col("text")).alias("text"))
    gone = docs.where(k == 5).select(F.concat(F.lit("gone/"), doc_path()).alias("path"), "text")
    return kept.unionByName(gone)


_DIFF = f"""{CORPUS_SQL}, diff AS (SELECT path, CASE WHEN doc_id % 7 = 3 THEN 'added' WHEN doc_id % 7 = 1 THEN 'modified' ELSE 'unchanged' END AS change FROM corpus
  UNION ALL SELECT 'gone/' || path, 'deleted' FROM corpus WHERE doc_id % 7 = 5)"""


@query(f"WITH {_DIFF} SELECT path, change FROM diff")
def a8_diff_snapshots(spark, sf_dir):
    return source.diff_snapshots(_old(spark, sf_dir), corpus(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT path, CASE WHEN change IN ('added', 'modified') THEN 'checked' ELSE 'unchanged_dependency' END AS status FROM diff WHERE change <> 'deleted'")
def a9_check_changed(spark, sf_dir):
    new = corpus(spark, sf_dir)
    return source.check_changed(new, source.diff_snapshots(_old(spark, sf_dir), new)).select("path", "status")


@query(f"""WITH {CORPUS_SQL}, x AS (SELECT CASE WHEN path LIKE 'src1/%' THEN 'excluded' WHEN strlen(text) > 6000 THEN 'gap' ELSE 'checked' END AS status,
  CASE WHEN path LIKE 'src1/%' THEN 'first' WHEN strlen(text) > 6000 THEN 'oversized' END AS reason FROM corpus)
SELECT status, reason, count(*) AS n_paths FROM x GROUP BY status, reason""")
def a10_coverage(spark, sf_dir):
    marked = selection.apply_exclusions(corpus(spark, sf_dir), [("src1/**", "first")])
    left = marked.where("status = 'checked'").select("path", F.col("text").cast("binary").alias("content"))
    return source.coverage_counts(source.coverage(marked.where("status = 'excluded'"), source.classify(left, 6000)))


@query(f"""WITH RECURSIVE {CORPUS_SQL}, {_SIZED}, n AS (SELECT path, CAST(n_bytes AS BIGINT) AS n_bytes, row_number() OVER (ORDER BY path) AS i FROM sized),
q(i, path, n_bytes, f, b, reason) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR UNION ALL
  SELECT n.i, n.path, n.n_bytes, CASE WHEN q.f < 150 AND q.b + n.n_bytes <= 400000 THEN q.f + 1 ELSE q.f END, CASE WHEN q.f < 150 AND q.b + n.n_bytes <= 400000 THEN q.b + n.n_bytes ELSE q.b END,
    CASE WHEN q.f >= 150 THEN 'source_file_limit' WHEN q.b + n.n_bytes > 400000 THEN 'source_snapshot_limit' END FROM q JOIN n ON n.i = q.i + 1)
SELECT path, n_bytes, reason, CASE WHEN reason IS NULL THEN 'checked' ELSE 'gap' END AS status FROM q WHERE i > 0""")
def a11_cumulative_quota(spark, sf_dir):
    sized = with_digest(corpus(spark, sf_dir)).select("path", "n_bytes")
    return selection.cumulative_quota(sized, 150, 400_000)


@query(f"""WITH {CORPUS_SQL}, {RULES_SQL}, c AS (SELECT path, (path LIKE 'src9/%') AS is_ignored, CASE WHEN path LIKE 'src8/%' THEN 'excluded' WHEN strlen(text) > 6000 THEN 'gap' ELSE 'checked' END AS status FROM corpus)
SELECT rule_id, scope_reason, count(*) AS n_paths FROM (SELECT rule_id, CASE WHEN is_ignored THEN 'ignored' WHEN status = 'excluded' THEN 'excluded: old' WHEN status = 'gap' THEN 'gap: oversized'
  WHEN NOT regexp_matches(path, include_re) THEN 'not_included' WHEN regexp_matches(path, exclude_re) THEN 'excluded_by_rule' WHEN rule_id = 'global/insult' OR rule_id = 'local/token' AND NOT EXISTS (SELECT 1 FROM corpus WHERE path = 'src0/fr/0.txt') THEN 'missing_required_file' ELSE 'in_scope' END AS scope_reason
  FROM c, rules WHERE mode <> 'disabled') GROUP BY rule_id, scope_reason""")
def a12_explain_scope(spark, sf_dir):
    files = selection.apply_exclusions(corpus(spark, sf_dir), [("src8/**", "old")])
    size = F.octet_length("text") > 6000
    status = F.when(F.col("status") == "excluded", "excluded").when(size, "gap").otherwise("checked")
    reason = F.when(F.col("status") == "excluded", F.col("reason")).when(size, "oversized")
    files = files.select("path", selection.ignored(F.col("path"), [("src9/**", False)]).alias("is_ignored"), status.alias("status"), reason.alias("reason"))
    scopes = rule_rows(spark)
    shown = scope.explain_scope(scopes.select("rule_id", "include_re", "exclude_re"), files, scope.require_files(scopes, files))
    return shown.groupBy("rule_id", "scope_reason").agg(F.count("*").alias("n_paths"))


def part_rules(spark, sf_dir):
    """Rule rows that the part table stands for: one a part."""
    p = table(spark, sf_dir, "part")
    flags = F.struct(*[F.lit(False).alias(n) for n in ("case_insensitive", "multi_line", "dot_matches_new_line", "ignore_whitespace", "crlf")])
    return p.select(
        F.concat(F.when(F.col("p_partkey") % 3 == 0, "global/").otherwise("local/"), F.lit("part-"), F.col("p_partkey").cast("string")).alias("rule_id"),
        F.when(F.col("p_size") % 3 == 0, "enforced").when(F.col("p_size") % 3 == 1, "advisory").otherwise("disabled").alias("mode"),
        F.lit("info").alias("severity"), F.lit("file").alias("execution"), F.lit("detect").alias("intent"),
        F.struct(
            F.split("p_name", " ").alias("include"), F.array(F.struct(F.col("p_brand").alias("glob"), F.col("p_type").alias("reason"))).alias("exclude"), F.array().cast("array<string>").alias("require_files")
        ).alias("scope"),
        F.create_map(F.lit("name"), F.struct(F.col("p_name").alias("regex"), flags.alias("flags"))).alias("patterns"),
        F.create_map(F.lit("hit"), F.struct(F.lit("review").alias("kind"), F.col("p_type").alias("message"), F.lit("").alias("help"))).alias("diagnostics"),
    )


_PART_ID = "CASE WHEN p_partkey % 3 = 0 THEN 'global/' ELSE 'local/' END || 'part-' || p_partkey"


@query(f"""SELECT {_PART_ID} AS rule_id, 'include' AS role, CAST(i - 1 AS INTEGER) AS ord, string_split(p_name, ' ')[i] AS glob, NULL::VARCHAR AS reason FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)
UNION ALL SELECT {_PART_ID}, 'exclude', 0::INTEGER, p_brand, p_type FROM part""")
def b1_explode_rules(spark, sf_dir):
    return rule_tables.explode_scope(part_rules(spark, sf_dir))


@query(f"SELECT {_PART_ID} AS rule_id, 'name' AS alias, p_name AS regex, 'hit' AS code, 'review' AS kind, p_type AS message FROM part")
def b1_explode_patterns(spark, sf_dir):
    r = part_rules(spark, sf_dir)
    codes = rule_tables.explode_diagnostics(r).select("rule_id", "code", "kind", "message")
    return rule_tables.explode_patterns(r).select("rule_id", "alias", "regex").join(codes, "rule_id")


@query(f"""WITH r AS (SELECT {_PART_ID} AS rule_id, CASE p_size % 3 WHEN 0 THEN 'enforced' WHEN 1 THEN 'advisory' ELSE 'disabled' END AS mode FROM part),
o AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'global/' ELSE 'local/' END || 'part-' || s_suppkey AS rule_id, 'advisory' AS mode FROM supplier)
SELECT r.rule_id, coalesce(o.mode, r.mode) AS mode, NULL::VARCHAR AS problem FROM r LEFT JOIN o USING (rule_id)
UNION ALL SELECT o.rule_id, NULL, CASE WHEN o.rule_id LIKE 'global/%' THEN 'inactive_override' ELSE 'unknown_rule' END FROM o WHERE o.rule_id NOT IN (SELECT rule_id FROM r)""")
def b2_effective_mode(spark, sf_dir):
    key = F.col("s_suppkey")
    over = table(spark, sf_dir, "supplier").select(F.concat(F.when(key % 2 == 0, "global/").otherwise("local/"), F.lit("part-"), key.cast("string")).alias("rule_id"), F.lit("advisory").alias("mode"))
    return rule_tables.effective_mode(part_rules(spark, sf_dir), over, "global")


def _framed(*parts: str) -> str:
    return " || ".join(f"unhex(lpad(printf('%x', strlen({p})), 16, '0')) || encode({p})" for p in parts)


@query(f"""SELECT {_PART_ID} AS rule_id, 'sha256:' || sha256({_framed("'WT-PACKAGE-1'", "'check.txt'", 'p_name', "'rule.json'", 'p_type')}) AS rule_digest FROM part""")
def b3_rule_digests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat(F.when(F.col("p_partkey") % 3 == 0, "global/").otherwise("local/"), F.lit("part-"), F.col("p_partkey").cast("string"))
    files = p.select(key.alias("rule_id"), F.inline(F.array(F.struct(F.lit("rule.json").alias("path"), F.col("p_type").alias("content")), F.struct(F.lit("check.txt").alias("path"), F.col("p_name").alias("content")))))
    return rule_tables.package_digests(files)


@query(f"""WITH x AS (SELECT {_PART_ID} AS rule_id, p_name FROM part)
SELECT rule_id, 'sha256:' || sha256({_framed("'execution-1'", '''('{"rule_id":"' || rule_id || '","execution":"file","patterns":{"name":{"regex":"' || p_name || '","flags":{"case_insensitive":false,"multi_line":false,"dot_matches_new_line":false,"ignore_whitespace":false,"crlf":false}}},"codes":["hit"]}')''')}) AS execution_digest FROM x""")
def b3_execution_digests(spark, sf_dir):
    return rule_tables.execution_digests(part_rules(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL} SELECT path, regexp_matches(path, '^src1[^/]*/[^/]*/[^/]*[.]txt$') AS star, regexp_matches(path, '^src[^/]/en/.*$') AS one, regexp_matches(path, '^.*/(en|de)/[1-4][^/]*$') AS class_, regexp_matches(path, '^src[^0-4]/.*$') AS negated FROM corpus""")
def c1_glob_match(spark, sf_dir):
    p = F.col("path")
    globs = {"star": "src1*/*/*.txt", "one": "src?/en/**", "class_": "**/{en,de}/[1-4]*", "negated": "src[!0-4]/**"}
    return corpus(spark, sf_dir).select("path", *[glob_match(p, g).alias(n) for n, g in globs.items()])


@query(f"WITH {CORPUS_SQL}, {RULES_SQL} SELECT rule_id, path FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL}")
def c2_scope_join(spark, sf_dir):
    return scope.scope_join(scope.scope_patterns(rules(spark)), corpus(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, {RULES_SQL} SELECT rule_id, CASE rule_id WHEN 'global/insult' THEN EXISTS (SELECT 1 FROM corpus WHERE path = 'missing.txt') WHEN 'local/token' THEN EXISTS (SELECT 1 FROM corpus WHERE path = 'src0/fr/0.txt') ELSE TRUE END AS applicable FROM rules WHERE mode <> 'disabled'")
def c3_require_files(spark, sf_dir):
    return scope.require_files(rule_rows(spark), corpus(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, g(rule_id, "glob", regex) AS (VALUES ('local/mail', '*/en/**', '^[^/]*/en/.*$'), ('local/mail', '*/de/**', '^[^/]*/de/.*$'), ('local/nowhere', 'nowhere/**', '^nowhere/.*$'), ('local/nowhere', 'src2/{{es,fr}}/*', '^src2/(es|fr)/[^/]*$'), ('global/licence', 'src?/en/*', '^src[^/]/en/[^/]*$'), ('local/token', 'src[0-4]/**', '^src[0-4]/.*$'), ('local/licence', '**', '^.*$'), ('local/address', '**', '^.*$'))
SELECT rule_id, "glob" FROM g WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE regexp_matches(path, g.regex))""")
def c4_unmatched_includes(spark, sf_dir):
    from .base import RULES

    globs = spark.createDataFrame([(r[0], g, glob_regex(g)) for r in RULES if r[2] != "disabled" for g in r[6]], "rule_id string, glob string, regex string")
    files = corpus(spark, sf_dir)
    return scope.unmatched_includes(globs, files, scope.require_files(rule_rows(spark), files))


@query(f"WITH {CORPUS_SQL}, {RULES_SQL} SELECT rule_id, count(path) AS n_files FROM rules LEFT JOIN corpus ON {SCOPE_SQL} WHERE mode <> 'disabled' GROUP BY rule_id")
def c5_scoped_file_counts(spark, sf_dir):
    return scope.scoped_file_counts(rule_rows(spark), corpus(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, {RULES_SQL} SELECT path, 'oversized' AS reason FROM corpus WHERE strlen(text) > 6000 AND EXISTS (SELECT 1 FROM rules WHERE rule_id IN ('local/mail', 'local/token', 'global/licence') AND {SCOPE_SQL})")
def c6_relevant_gaps(spark, sf_dir):
    gaps = source.classify(corpus(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content")), 6000).where("status = 'gap'").select("path", "reason")
    some = rule_rows(spark).where(F.col("rule_id").isin("local/mail", "local/token", "global/licence"))
    return scope.relevant_gaps(gaps, some.select("include_re", "exclude_re"))


__all__ = ["rules"]
