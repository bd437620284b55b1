"""Queries of text and pattern operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.functions import text as t
from corpusward.operators import patterns

from .base import CORPUS_SQL, corpus, pages, query, spans_sql, table

_LIC, _MAIL = "[Ll]icen[sc]e", "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+"

_LINES = """l AS (SELECT path, doc_id, i, string_split(body, chr(10))[i] AS raw, len(string_split(body, chr(10))) AS n FROM (SELECT path, doc_id, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM b)),
m AS (SELECT path, doc_id, i, n, raw, CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM l),
lines AS (SELECT path, doc_id, CAST(i AS BIGINT) AS line_no, start_byte, CASE WHEN i < n AND raw LIKE '%' || chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS text FROM m WHERE i < n OR raw <> '')"""


@query(f"""WITH {CORPUS_SQL}, b AS (SELECT path, doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 1 THEN text || chr(10) ELSE text END AS body FROM corpus), {_LINES}
SELECT path, line_no, start_byte, start_byte + strlen(text) AS end_byte, text FROM lines""")
def d1_lines(spark, sf_dir):
    k = F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents")
    body = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    from .base import doc_path

    return patterns.lines(docs.select(doc_path().alias("path"), body.alias("text")))


@query(f"WITH {CORPUS_SQL} SELECT path, contains(text, 'token') AS has_token, contains(text, '') AS has_empty FROM corpus")
def d2_contains(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", t.contains(F.col("text"), F.lit("token")).alias("has_token"), t.contains(F.col("text"), F.lit("")).alias("has_empty"))


@query(f"WITH {CORPUS_SQL} SELECT path, starts_with(text, 'The ') AS starts, ends_with(text, '.') AS ends FROM corpus")
def d3_starts_ends(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", t.starts_with(F.col("text"), F.lit("The ")).alias("starts"), t.ends_with(F.col("text"), F.lit(".")).alias("ends"))


@query(f"""WITH {CORPUS_SQL} SELECT path, text AS trimmed FROM (SELECT path, regexp_replace(regexp_replace(text, '^[\\s\\x{{A0}}\\x{{3000}}]+', ''), '[\\s\\x{{A0}}\\x{{3000}}]+$', '') AS text FROM corpus)""")
def d4_trim(spark, sf_dir):
    padded = F.concat(F.lit("　 \t"), F.col("text"), F.lit(" \n"))
    return corpus(spark, sf_dir).select("path", t.trim(padded).alias("trimmed"))


@query(f"WITH {CORPUS_SQL} SELECT path, len(string_split(text, '. ')) AS n_fields, string_split(text, '. ')[1] AS first_field, string_split(text, '. ')[-1] AS last_field FROM corpus")
def d5_split_literal(spark, sf_dir):
    parts = t.split_literal(F.col("text"), ". ")
    return corpus(spark, sf_dir).select("path", F.size(parts).cast("long").alias("n_fields"), parts[0].alias("first_field"), F.element_at(parts, -1).alias("last_field"))


@query(f"WITH {CORPUS_SQL} SELECT path, replace(text, 'aa', 'b') AS text FROM corpus")
def d6_replace(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", t.replace(F.col("text"), "aa", "b").alias("text"))


@query(f"WITH {CORPUS_SQL} SELECT path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM corpus")
def d7_len_bytes(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", t.len_bytes(F.col("text")).alias("n_bytes"))


@query("""SELECT doc_id, source || ':' || lang AS joined, source < lang AS less, d.quality IS NOT DISTINCT FROM d.toxic AS same FROM documents LEFT JOIN labels d USING (doc_id)""")
def d8_concat_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.concat("source", F.lit(":"), "lang").alias("joined"), (F.col("source") < F.col("lang")).alias("less"), t.same(F.col("quality"), F.col("toxic")).alias("same"))


@query("""SELECT event_id, event_id + user_id AS added, user_id - event_id AS taken, event_id * user_id AS times, (user_id - event_id) // NULLIF(user_id, 0) AS divided, (user_id - event_id) % NULLIF(user_id, 0) AS remainder FROM events""")
def d9_checked_math(spark, sf_dir):
    a, b = F.col("event_id"), F.col("user_id")
    m = lambda op, x, y: t.checked(op, x, y, "null")
    return table(spark, sf_dir, "events").select(
        "event_id", m("+", a, b).alias("added"), m("-", b, a).alias("taken"), m("*", a, b).alias("times"), m("/", b - a, b).alias("divided"), m("%", b - a, b).alias("remainder")
    )


@query(f"WITH {CORPUS_SQL} SELECT path, regexp_matches(text, '{_LIC}') AS is_match FROM corpus")
def e1_is_match(spark, sf_dir):
    return patterns.is_match(corpus(spark, sf_dir), _LIC).select("path", "is_match")


@query(f"WITH {CORPUS_SQL} {spans_sql('path', 'corpus', repr('[éèü]+[a-z]'))}")
def e2_find_all(spark, sf_dir):
    return patterns.find_all(corpus(spark, sf_dir), "[éèü]+[a-z]")


#: The domain's end takes part or does not, and is never empty; the rest always takes part and may be.
_PARTS = "([A-Za-z0-9._]+)@([A-Za-z0-9]+)[.](com|org|net)?([a-z]*)"


@query(f"""WITH {CORPUS_SQL}, f AS ({spans_sql('path', 'corpus', repr(_PARTS))})
SELECT path, ord, start_byte, end_byte, regexp_extract(text, '{_PARTS}', 1) AS user, regexp_extract(text, '{_PARTS}', 2) AS host, nullif(regexp_extract(text, '{_PARTS}', 3), '') AS tld, regexp_extract(text, '{_PARTS}', 4) AS rest FROM f""")
def e3_find_all_groups(spark, sf_dir):
    found = patterns.find_all(corpus(spark, sf_dir), "(?P<user>[A-Za-z0-9._]+)@(?P<host>[A-Za-z0-9]+)[.](?P<tld>com|org|net)?(?P<rest>[a-z]*)", groups=True)
    return found.select("path", "ord", "start_byte", "end_byte", *[F.col("groups")[g].alias(g) for g in ("user", "host", "tld", "rest")])


@query(f"""WITH {CORPUS_SQL}, o AS ({spans_sql('path', 'corpus', repr('[Ll]icen[sc]e[^.]*'))}), r AS (SELECT path || '#' || start_byte AS k, path, start_byte AS base, text FROM o),
i AS ({spans_sql('k', 'r', repr('[A-Z][a-z]+'))})
SELECT path, base, ord, start_byte + base AS start_byte, end_byte + base AS end_byte, i.text FROM i JOIN r USING (k)""")
def e4_find_in(spark, sf_dir):
    outer = patterns.find_all(corpus(spark, sf_dir), "[Ll]icen[sc]e[^.]*").withColumn("base", F.col("start_byte"))
    return patterns.find_in(outer, "[A-Z][a-z]+", ["path", "base"])


_HOST = "[A-Za-z0-9._]+@([A-Za-z0-9]+)[.]([0-9]+)?([xyz]*)"


@query(f"WITH {CORPUS_SQL} SELECT path, CASE WHEN hit THEN regexp_extract(text, '{_HOST}') END AS captured, CASE WHEN hit THEN regexp_extract(text, '{_HOST}', 1) END AS host, CASE WHEN hit THEN nullif(regexp_extract(text, '{_HOST}', 2), '') END AS number, CASE WHEN hit THEN regexp_extract(text, '{_HOST}', 3) END AS rest FROM (SELECT *, regexp_matches(text, '{_HOST}') AS hit FROM corpus)")
def e5_capture_text(spark, sf_dir):
    got = patterns.capture_text(corpus(spark, sf_dir), "[A-Za-z0-9._]+@(?P<host>[A-Za-z0-9]+)[.](?P<number>[0-9]+)?(?P<rest>[xyz]*)")
    return got.select("path", "captured", *[F.col("groups")[g].alias(g) for g in ("host", "number", "rest")])


#: Runs of digits, and the empty text before every other character and at the end, unless a run ends there.
@query(f"""WITH {CORPUS_SQL}, runs AS ({spans_sql('path', 'corpus', repr('[0-9]+'))}),
chars AS (SELECT path, unnest(list_append(cs, NULL)) AS c, unnest(range(1, len(cs) + 2)) AS i FROM (SELECT path, regexp_extract_all(text, '(?s).') AS cs FROM corpus)),
places AS (SELECT path, c, lag(c) OVER (PARTITION BY path ORDER BY i) AS before, CAST(coalesce(sum(strlen(c)) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS here FROM chars),
every AS (SELECT path, start_byte, end_byte, text FROM runs UNION ALL SELECT path, here, here, '' FROM places WHERE (c IS NULL OR c NOT BETWEEN '0' AND '9') AND (before IS NULL OR before NOT BETWEEN '0' AND '9'))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_byte) - 1 AS INTEGER) AS ord, start_byte, end_byte, text FROM every""")
def e6_zero_width(spark, sf_dir):
    return patterns.find_all(corpus(spark, sf_dir), "[0-9]*")


@query(f"WITH {CORPUS_SQL} SELECT path, literal, contains(corpus.text, literal) AS present FROM corpus, (SELECT unnest(['token', 'tok', 'licensed', 'License', 'the']) AS literal)")
def e7_literal_presence(spark, sf_dir):
    return patterns.literal_presence(corpus(spark, sf_dir), ["token", "tok", "licensed", "License", "the"])


@query(f"""WITH {CORPUS_SQL}, words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS literal FROM benchmark)
SELECT literal, count(*) AS n_texts FROM words JOIN corpus ON contains(corpus.text, literal) GROUP BY literal""")
def e7_literal_hits(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("literal"))
    return patterns.literal_hits(corpus(spark, sf_dir), words).groupBy("literal").agg(F.count("*").alias("n_texts"))


@query(f"WITH {CORPUS_SQL}, f AS ({spans_sql('path', 'corpus', repr('[0-9]{3,}'))}) SELECT path, start_byte, end_byte, text FROM f WHERE ord = 0")
def e8_first_match(spark, sf_dir):
    return patterns.first_match(corpus(spark, sf_dir), "[0-9]{3,}")


@query(f"""WITH {CORPUS_SQL} SELECT path, 0::BIGINT AS start_byte, CAST(strlen(regexp_extract(text, '^[A-Z]*')) AS BIGINT) AS end_byte, regexp_extract(text, '^[A-Z]*') AS text FROM corpus""")
def e8_first_match_empty(spark, sf_dir):
    return patterns.first_match(corpus(spark, sf_dir), "[A-Z]*")


__all__ = ["pages"]
