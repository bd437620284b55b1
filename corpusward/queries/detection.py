"""Queries of detection templates and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.operators import detect, findings, scope
from corpusward.sources import corpus as source

from .base import CORPUS_SQL, RULES_SQL, SCOPE_SQL, corpus, query, rule_rows, spans_sql, table

#: All matches of every enabled rule.
MATCHES = f"""{CORPUS_SQL}, {RULES_SQL}, pairs AS (SELECT rule_id, path, text, regex, needle, code, most, kind, severity, mode FROM corpus, rules WHERE mode <> 'disabled' AND {SCOPE_SQL}),
found AS ({spans_sql('rule_id, path, code, needle, most, regex, kind, severity, mode', 'pairs')})"""
_RAW = "rule_id, path, code, start_byte, end_byte"


def raw(spark, sf_dir):
    return detect.detect_each(rule_rows(spark), corpus(spark, sf_dir))


def located(spark, sf_dir):
    return detect.detect_located(rule_rows(spark), corpus(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT {_RAW} FROM found")
def g1_detect_each(spark, sf_dir):
    return raw(spark, sf_dir)


@query(f"WITH {MATCHES} SELECT {_RAW} FROM found WHERE contains(text, needle)")
def g2_detect_each_where(spark, sf_dir):
    return detect.detect_each_where(rule_rows(spark), corpus(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT rule_id, path, code, 0::BIGINT AS start_byte, CAST(strlen(text) AS BIGINT) AS end_byte FROM pairs WHERE NOT regexp_matches(text, regex)")
def g3_detect_absence(spark, sf_dir):
    return detect.detect_absence(rule_rows(spark), corpus(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT rule_id, path, code, 0::BIGINT AS start_byte, CAST(strlen(text) AS BIGINT) AS end_byte FROM pairs WHERE contains(text, needle)")
def g4_detect_presence(spark, sf_dir):
    return detect.detect_presence(rule_rows(spark), corpus(spark, sf_dir))


@query(f"""WITH {MATCHES}, l AS (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pairs WHERE regexp_matches(text, regex)),
m AS (SELECT rule_id, path, code, regex, i, string_split(text, chr(10))[i] AS raw, CAST(coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i - 1], lambda x: strlen(x) + 1)), 0) AS BIGINT) AS start_byte FROM l)
SELECT rule_id, path, code, start_byte, start_byte + strlen(raw) AS end_byte FROM m WHERE regexp_matches(raw, regex)""")
def g5_detect_lines(spark, sf_dir):
    return detect.detect_lines(rule_rows(spark), corpus(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, o AS ({spans_sql('path', 'corpus', repr('[^.]*[.]'))}), i AS ({spans_sql('path', 'corpus', repr('token|worthless|[Ll]icen[sc]e'))})
SELECT path, start_byte, end_byte, EXISTS (SELECT 1 FROM o WHERE o.path = i.path AND i.start_byte >= o.start_byte AND i.end_byte <= o.end_byte) AS enclosed FROM i""")
def g6_detect_enclosed(spark, sf_dir):
    from corpusward.operators.patterns import find_all
    from corpusward.operators.spans import inside, outside

    docs = corpus(spark, sf_dir)
    inner = find_all(docs, "token|worthless|[Ll]icen[sc]e")
    outer = find_all(docs.where(F.col("text").rlike("token|worthless|[Ll]icen[sc]e")), "[^.]*[.]")
    part = lambda d, v: d.select("path", "start_byte", "end_byte", F.lit(v).alias("enclosed"))
    return part(inside(inner, outer), True).unionByName(part(outside(inner, outer), False))


@query(f"""WITH {CORPUS_SQL}, v(rule_id, code, regex, outer_regex, within) AS (VALUES ('local/in', 'a', 'token|[Ll]icen[sc]e', '[(][^)]*[)]|"[^"]*"|[A-Z][^.]*[.]', TRUE), ('local/out', 'b', '[0-9]+', '[0-9]+[.][0-9.]+', FALSE), ('global/in', 'c', 'token|[Ll]icen[sc]e', '[^.]*[.]', TRUE)),
p AS (SELECT * FROM corpus, v), i AS ({spans_sql('rule_id, path, code, within, regex', 'p')}), o AS ({spans_sql('rule_id, path, outer_regex', 'p', 'outer_regex')})
SELECT {_RAW} FROM i WHERE within = EXISTS (SELECT 1 FROM o WHERE o.rule_id = i.rule_id AND o.path = i.path AND i.start_byte >= o.start_byte AND i.end_byte <= o.end_byte)""")
def g6_detect_enclosed_rules(spark, sf_dir):
    rows = [
        ("local/in", "a", "token|[Ll]icen[sc]e", '[(][^)]*[)]|"[^"]*"|[A-Z][^.]*[.]', True), ("local/out", "b", "[0-9]+", "[0-9]+[.][0-9.]+", False), ("global/in", "c", "token|[Ll]icen[sc]e", "[^.]*[.]", True),
        ("local/broken", "d", "[0-9]+", "(", False),
    ]
    rules = spark.createDataFrame([(*r, "^", "(?!)") for r in rows], "rule_id string, code string, regex string, outer_regex string, within boolean, include_re string, exclude_re string")
    return detect.detect_enclosed(rules, corpus(spark, sf_dir))


_PAIR = "([A-Za-z]+) ([A-Za-z]+)[.]"


@query(f"""WITH {CORPUS_SQL}, f AS ({spans_sql('path', 'corpus', repr(_PAIR))})
SELECT 'local/pair' AS rule_id, path, 'pair' AS code, start_byte, end_byte FROM f WHERE regexp_extract(text, '{_PAIR}', 1) = regexp_extract(text, '{_PAIR}', 2)""")
def g7_detect_capture_compare(spark, sf_dir):
    rule = spark.createDataFrame([("local/pair", "pair", _PAIR, "^.*", "(?!)")], "rule_id string, code string, regex string, include_re string, exclude_re string")
    return detect.detect_capture_compare(rule, corpus(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT rule_id, path, count(*) AS n_matches FROM found GROUP BY rule_id, path, most HAVING count(*) > most")
def g8_detect_count(spark, sf_dir):
    return detect.detect_count(rule_rows(spark), corpus(spark, sf_dir))


@query(f"""WITH {MATCHES}, n AS (SELECT rule_id, text FROM found GROUP BY rule_id, text HAVING count(DISTINCT path) > 1)
SELECT {_RAW} FROM found JOIN n USING (rule_id, text)""")
def g9_defined_twice(spark, sf_dir):
    return detect.defined_twice(rule_rows(spark), corpus(spark, sf_dir))


def _use_rules(spark):
    schema = "rule_id string, code string, regex string, include_re string, exclude_re string"
    use = spark.createDataFrame([("local/use", "name", "[A-Z][a-z]{11,}", "^src[0-4]/", "(?!)")], schema)
    define = spark.createDataFrame([("local/define", "name", "[A-Z][a-z]{11,}", "^src[5-9]/", "(?!)")], schema)
    return use, define


@query(f"""WITH {CORPUS_SQL}, u AS ({spans_sql('path', "(SELECT * FROM corpus WHERE regexp_matches(path, '^src[0-4]/'))", repr('[A-Z][a-z]{11,}'))}), d AS ({spans_sql('path', "(SELECT * FROM corpus WHERE regexp_matches(path, '^src[5-9]/'))", repr('[A-Z][a-z]{11,}'))})
SELECT 'local/use' AS rule_id, path, 'name' AS code, start_byte, end_byte FROM u WHERE text NOT IN (SELECT text FROM d)""")
def g9_used_undefined(spark, sf_dir):
    use, define = _use_rules(spark)
    return detect.used_undefined(use, define, corpus(spark, sf_dir))


def _gaps(spark, sf_dir):
    files = corpus(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))
    return source.classify(files, 6000).where("status = 'gap'").select("path", "reason")


@query(f"""WITH {MATCHES}, hit AS (SELECT DISTINCT rule_id FROM pairs WHERE strlen(text) > 6000)
SELECT rule_id, path, start_byte, NULL::VARCHAR AS error FROM found WHERE rule_id NOT IN (SELECT rule_id FROM hit) UNION ALL SELECT rule_id, NULL, NULL, 'source_gap' FROM hit""")
def g10_repository_gap_guard(spark, sf_dir):
    kept, errors = detect.repository_gap_guard(raw(spark, sf_dir), rule_rows(spark), _gaps(spark, sf_dir))
    none = F.lit(None)
    return kept.select("rule_id", "path", "start_byte", none.cast("string").alias("error")).unionByName(
        errors.select("rule_id", none.cast("string").alias("path"), none.cast("long").alias("start_byte"), "error")
    )


@query(f"WITH {MATCHES} SELECT rule_id, path, ord, start_byte, end_byte, text FROM found")
def g11_shared_evaluation(spark, sf_dir):
    return detect.shared_evaluation(rule_rows(spark), corpus(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT rule_id, path, ord, start_byte, end_byte, text FROM found")
def g11_unshared_evaluation(spark, sf_dir):
    return detect.shared_evaluation(rule_rows(spark), corpus(spark, sf_dir), shared=False)


@query(f"""WITH {MATCHES}, n AS (SELECT rule_id, path, count(*) AS n FROM found GROUP BY rule_id, path)
SELECT rule_id, path, CASE WHEN n > 2 THEN 'diagnostic_limit' END AS error, CASE WHEN n > 2 THEN 0 ELSE n END AS n_findings FROM n""")
def g12_enforce_limits(spark, sf_dir):
    kept, errors = detect.enforce_limits(raw(spark, sf_dir), 2)
    good = kept.groupBy("rule_id", "path").agg(F.count("*").alias("n_findings")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors.withColumn("n_findings", F.lit(0).cast("long")))


@query(f"""WITH {MATCHES}, n AS (SELECT rule_id, path, count(*) AS n FROM found GROUP BY rule_id, path)
SELECT rule_id, path, CASE WHEN n > 1 THEN 'match_limit' END AS error, CASE WHEN n > 1 THEN 0 ELSE n END AS n_findings FROM n""")
def g12_call_limit(spark, sf_dir):
    kept, errors = detect.detect_each_within(rule_rows(spark), corpus(spark, sf_dir), 1)
    good = kept.groupBy("rule_id", "path").agg(F.count("*").alias("n_findings")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors.withColumn("n_findings", F.lit(0).cast("long")))


@query(f"WITH {MATCHES} SELECT {_RAW} FROM found WHERE NOT (rule_id LIKE 'local/%' AND path LIKE 'src2/%')")
def g13_failed_invocations(spark, sf_dir):
    failed = scope.scope_join(rule_rows(spark), corpus(spark, sf_dir)).where("rule_id like 'local/%' and path like 'src2/%'")
    return detect.failed_invocations(raw(spark, sf_dir), failed)


@query(f"WITH {MATCHES} SELECT DISTINCT {_RAW} FROM found")
def g14_dedup_order(spark, sf_dir):
    r = raw(spark, sf_dir)
    return detect.dedup_order(r.unionByName(r.where("start_byte % 2 = 0")))


_COORD = """(SELECT f.*, c.text AS body, decode(encode(c.text)[1:f.start_byte]) AS before, decode(encode(c.text)[1:f.end_byte]) AS until FROM found f JOIN corpus c USING (path))"""


@query(f"""WITH {MATCHES} SELECT {_RAW}, CAST(len(string_split(before, chr(10))) AS BIGINT) AS start_line, CAST(length(string_split(before, chr(10))[-1]) + 1 AS BIGINT) AS start_column,
  CAST(len(string_split(until, chr(10))) AS BIGINT) AS end_line, CAST(length(string_split(until, chr(10))[-1]) + 1 AS BIGINT) AS end_column FROM {_COORD}""")
def g15_add_coordinates(spark, sf_dir):
    return located(spark, sf_dir).select(*detect.RAW, "start_line", "start_column", "end_line", "end_column")


@query(f"""WITH {MATCHES}, x AS (SELECT *, len(string_split(before, chr(10))) AS n, string_split(body, chr(10)) AS ls FROM {_COORD})
SELECT {_RAW}, CASE WHEN n > 1 THEN ls[n - 1] END AS before, ls[n] AS line, ls[n + 1] AS after, CAST(length(string_split(before, chr(10))[-1]) + 1 + length(text) AS BIGINT) AS caret_end_column, 0::BIGINT AS extra_lines FROM x""")
def g16_add_snippet(spark, sf_dir):
    return located(spark, sf_dir).select(*detect.RAW, "snippet.*")


#: Rules with flags, an anchor, a Unicode class, two patterns of one rule, empty matches, and one outside the language.
_FLAGGED = [
    ("local/any-case", "word", "LICENSE", "ci"), ("local/last", "end", "[a-z]+[.]$", ""), ("local/unicode", "letter", r"\w{14,}", ""), ("local/digits", "run", "[0-9]*", ""),
    ("local/two", "mail", "[a-z]+@", ""), ("local/two", "token", "token", ""), ("local/named", "name", "(?P<k>token)", ""), ("local/broken", "none", "(token", ""), ("local/look", "none", "(?=token)", ""),
]


_LONG_WORD = r"'[\p{L}\p{M}\p{Nd}\p{Pc}]{14,}'"


def _flagged(spark):
    from .base import dimension

    rows = dimension(spark, [(*r, "^src[0-2]/en/", "(?!)") for r in _FLAGGED], dict.fromkeys(("rule_id", "code", "regex", "on", "include_re", "exclude_re"), "string"))
    return rows.withColumn("case_insensitive", F.col("on") == "ci").drop("on")


@query(f"""WITH {CORPUS_SQL}, c AS (SELECT * FROM corpus WHERE regexp_matches(path, '^src[0-2]/en/')),
l AS ({spans_sql('path', 'c', repr('(?i)LICENSE'))}), t AS ({spans_sql('path', 'c', repr('token'))}), m AS ({spans_sql('path', 'c', repr('[a-z]+@'))}), r AS ({spans_sql('path', 'c', repr('[0-9]+'))}),
w AS ({spans_sql('path', 'c', _LONG_WORD)}),
e AS (SELECT path, CAST(strlen(text) AS BIGINT) AS end_byte, regexp_extract(text, '[a-z]+[.]$') AS x FROM c WHERE regexp_matches(text, '[a-z]+[.]$')),
chars AS (SELECT path, unnest(list_append(cs, NULL)) AS ch, unnest(range(1, len(cs) + 2)) AS i FROM (SELECT path, regexp_extract_all(text, '(?s).') AS cs FROM c)),
places AS (SELECT path, ch, lag(ch) OVER (PARTITION BY path ORDER BY i) AS before, CAST(coalesce(sum(strlen(ch)) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS here FROM chars)
SELECT 'local/any-case' AS rule_id, path, 'word' AS code, start_byte, end_byte FROM l UNION ALL SELECT 'local/two', path, 'token', start_byte, end_byte FROM t UNION ALL SELECT 'local/named', path, 'name', start_byte, end_byte FROM t
UNION ALL SELECT 'local/two', path, 'mail', start_byte, end_byte FROM m UNION ALL SELECT 'local/unicode', path, 'letter', start_byte, end_byte FROM w UNION ALL SELECT 'local/last', path, 'end', end_byte - strlen(x), end_byte FROM e
UNION ALL SELECT 'local/digits', path, 'run', start_byte, end_byte FROM r UNION ALL SELECT 'local/digits', path, 'run', here, here FROM places WHERE (ch IS NULL OR ch NOT BETWEEN '0' AND '9') AND (before IS NULL OR before NOT BETWEEN '0' AND '9')""")
def g1_translated_patterns(spark, sf_dir):
    return detect.detect_each(_flagged(spark), corpus(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL} SELECT rule_id, error, count(*) AS n_paths FROM corpus, (VALUES ('local/broken', 'invalid_pattern'), ('local/look', 'invalid_pattern')) v(rule_id, error) WHERE regexp_matches(path, '^src[0-2]/en/') GROUP BY ALL""")
def g13_pattern_errors(spark, sf_dir):
    rows = _flagged(spark)
    scoped = scope.scope_join(rows.select("rule_id", "include_re", "exclude_re").distinct(), corpus(spark, sf_dir))
    return scoped.join(detect.pattern_errors(rows), "rule_id").groupBy("rule_id", "error").agg(F.count("*").alias("n_paths"))


#: Patterns of the rule language, and what they are for an engine that knows less of it.
_LANGUAGE = [
    ("posix", "[[:digit:]]{4,}", "[0-9]{4,}"), ("one-letter", r"\pL{12,}", r"\pL{12,}"), ("script", r"\p{Cyrillic}+|\p{Greek}+", r"\p{Cyrillic}+|\p{Greek}+"), ("named", "(?P<my_name>token)", "token"), ("difference", "[a-z--[aeiou]]{6,}", "[b-df-hj-np-tv-z]{6,}"),
    ("symmetric", "[A-F~~D-Z]{2,}", "[A-CG-Z]{2,}"), ("intersection", "[[:alpha:]&&[^a-z]]{3,}", "[A-Z]{3,}"), ("code", r"\x{54}\u{68}[^[:lower:]]", "Th[^a-z]"), ("line-end", "(?m)[a-z]+[.]$", "(?m)[a-z]+[.]$"), ("bracket", "[]$]+[a-z]", r"[\]$]+[a-z]"),
    ("in-scope", "(?i:LICEN)[cs]e", "[Ll][Ii][Cc][Ee][Nn][cs]e"), ("twice", "(?:ab)++[.]", "(?:ab)+[.]"), ("swapped", "(?U)worth.+s", "worth.+?s"), ("spaced", "(?x) [0-9]+ [.] \\  # a number", "[0-9]+[.] "), ("broken", r"\p{Nope}", ""),
]
_LANGUAGE_SQL = ", ".join("('local/{}', '{}')".format(n, q.replace("'", "''")) for n, _, q in _LANGUAGE if q)


@query(f"""WITH {CORPUS_SQL}, v(rule_id, regex) AS (VALUES {_LANGUAGE_SQL}), p AS (SELECT rule_id, path, text, regex FROM corpus, v), f AS ({spans_sql('rule_id, path, regex', 'p')})
SELECT rule_id, path, 'c' AS code, start_byte, end_byte FROM f""")
def g1_pattern_language(spark, sf_dir):
    from .base import dimension

    rows = dimension(spark, [(f"local/{n}", "c", p, "^", "(?!)") for n, p, _ in _LANGUAGE], dict.fromkeys(("rule_id", "code", "regex", "include_re", "exclude_re"), "string"))
    return detect.detect_each(rows, corpus(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, f AS ({spans_sql('path', 'corpus', repr('(?:^|[^0-9A-Za-z_])[a-z]?[a-z][.]').replace("''", "'"))})
SELECT 'local/halves' AS rule_id, path, 'pair' AS code, end_byte - length(regexp_extract(text, '[a-z]+')) - 1 AS start_byte, end_byte FROM f
WHERE length(regexp_extract(text, '[a-z]+')) = 1 OR regexp_extract(text, '([a-z])([a-z])', 1) <> regexp_extract(text, '([a-z])([a-z])', 2)""")
def g7_groups_in_context(spark, sf_dir):
    """Words of one or two letters before a full stop whose letters differ; a missing letter differs from any."""
    rule = spark.createDataFrame([("local/halves", "pair", r"(?-u:\b)([a-z])?([a-z])[.]", "^.*", "(?!)")], "rule_id string, code string, regex string, include_re string, exclude_re string")
    return detect.detect_capture_compare(rule, corpus(spark, sf_dir), equal=False)


def diagnostics(spark):
    from .base import RULES, dimension

    rows = [(r[0], r[1], r[5], f"{r[1]} found", f"look at {r[1]}") for r in RULES]
    return dimension(spark, rows, dict.fromkeys(("rule_id", "code", "kind", "message", "help"), "string"))


@query(f"WITH {MATCHES} SELECT {_RAW}, kind, severity, mode, code || ' found' AS message, 'look at ' || code AS help, mode IN ('enforced', 'advisory') AS blocking FROM found")
def g17_enrich(spark, sf_dir):
    return findings.enrich(raw(spark, sf_dir), rule_rows(spark), diagnostics(spark), strict=True)


@query(f"WITH {MATCHES} SELECT 'candidate/' || split_part(rule_id, '/', 2) AS rule_id, path, code, start_byte, end_byte, TRUE AS partial, FALSE AS reviewable FROM found WHERE rule_id IN ('local/mail', 'global/insult')")
def g18_preview_rules(spark, sf_dir):
    some = rule_rows(spark).where(F.col("rule_id").isin("local/mail", "global/insult", "local/address"))
    passing = spark.createDataFrame([("local/mail",), ("global/insult",)], "rule_id string")
    return detect.preview_rules(some, corpus(spark, sf_dir), passing)


__all__ = ["table"]
