"""Registry of queries, the tables they read, and the rule rows that most of them run."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.globs import any_glob_regex
from corpusward.sources.corpus import to_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (path, text)."""
    return to_corpus(table(spark, sf_dir, "documents"), doc_path(), F.col("text")).select("path", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as (path, text)."""
    return to_corpus(table(spark, sf_dir, "pages"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html")).select("path", "text")


#: (rule_id, code, mode, severity, intent, kind, include, exclude, require_files, regex, needle, most)
RULES = [
    ("local/licence", "mention", "enforced", "warning", "detect", "review", ["**"], ["src3/**"], [], "[Ll]icen[sc]e", "License", 1),
    ("local/address", "address", "enforced", "error", "detect", "violation", ["**"], [], [], "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "1.", 1),
    ("local/mail", "mail", "advisory", "error", "detect", "violation", ["*/en/**", "*/de/**"], ["src[5-7]/**"], [], "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+", "@example", 1),
    ("local/token", "secret", "advisory", "warning", "watch", "review", ["src[0-4]/**"], [], ["src0/fr/0.txt"], "token = \"([0-9a-f]+)\"", "token = \"a", 1),
    ("global/licence", "mention", "advisory", "info", "detect", "review", ["src?/en/*"], ["src1/**"], [], "[Ll]icen[sc]e", "license", 1),
    ("global/insult", "insult", "enforced", "error", "detect", "violation", ["**/*.txt"], [], ["missing.txt"], "worthless|moron", "moron", 1),
    ("global/off", "off", "disabled", "info", "detect", "review", ["**"], [], [], "nothing of the kind", "x", 1),
    ("local/nowhere", "none", "advisory", "info", "detect", "review", ["nowhere/**", "src2/{es,fr}/*"], [], [], "nothing of the kind", "x", 1),
]
#: The same rows for DuckDB, their scopes as patterns.
RULES_SQL = r"""rules(rule_id, code, mode, severity, intent, kind, include_re, exclude_re, regex, needle, most) AS (VALUES
  ('local/licence', 'mention', 'enforced', 'warning', 'detect', 'review', '^.*$', '^src3/.*$', '[Ll]icen[sc]e', 'License', 1),
  ('local/address', 'address', 'enforced', 'error', 'detect', 'violation', '^.*$', '^\z.', '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '1.', 1),
  ('local/mail', 'mail', 'advisory', 'error', 'detect', 'violation', '^[^/]*/(en|de)/.*$', '^src[5-7]/.*$', '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+', '@example', 1),
  ('local/token', 'secret', 'advisory', 'warning', 'watch', 'review', '^src[0-4]/.*$', '^\z.', 'token = "([0-9a-f]+)"', 'token = "a', 1),
  ('global/licence', 'mention', 'advisory', 'info', 'detect', 'review', '^src[^/]/en/[^/]*$', '^src1/.*$', '[Ll]icen[sc]e', 'license', 1),
  ('global/insult', 'insult', 'enforced', 'error', 'detect', 'violation', '^.*[.]txt$', '^\z.', 'worthless|moron', 'moron', 1),
  ('global/off', 'off', 'disabled', 'info', 'detect', 'review', '^.*$', '^\z.', 'nothing of the kind', 'x', 1),
  ('local/nowhere', 'none', 'advisory', 'info', 'detect', 'review', '^(nowhere/.*|src2/(es|fr)/[^/]*)$', '^\z.', 'nothing of the kind', 'x', 1))"""
CORPUS_SQL = "corpus AS (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, text, doc_id FROM documents)"
PAGES_SQL = "pages_ AS (SELECT concat('pages/', page_id, '.html') AS path, html AS text FROM pages)"
SCOPE_SQL = "regexp_matches(path, include_re) AND NOT regexp_matches(path, exclude_re)"


def spans_sql(keys: str, source: str, regex: str = "regex", text: str = "text") -> str:
    """DuckDB rows (keys, ord, start_byte, end_byte, text) of all matches in ``source``."""
    return f"""SELECT {keys}, CAST(i - 1 AS INTEGER) AS ord, start_byte, start_byte + strlen(m) AS end_byte, m AS text FROM (
  SELECT {keys}, i, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS start_byte
  FROM (SELECT {keys}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT {keys}, regexp_extract_all({text}, {regex}) AS ms, string_split_regex({text}, {regex}) AS gs FROM {source} WHERE regexp_matches({text}, {regex}))))"""


def digest_sql(domain: str, *parts: str) -> str:
    """DuckDB form of a framed digest of VARCHAR parts."""
    frame = lambda p: f"unhex(lpad(printf('%x', strlen({p})), 16, '0')) || encode({p})"
    return "'sha256:' || sha256(" + " || ".join(frame(p) for p in (f"'{domain}'", *parts)) + ")"


def rules(spark: SparkSession, enabled: bool = True) -> DataFrame:
    """The rule rows in the nested form of a rule table."""
    rows = [
        (r[0], r[2], r[3], "file", r[4], (r[6], [(g, "left out") for g in r[7]], r[8]), {"p": (r[9], (False,) * 5)}, {r[1]: (r[5], f"{r[1]} found", f"look at {r[1]}")})
        for r in RULES if not enabled or r[2] != "disabled"
    ]
    from corpusward.sources.rules import RULE_SCHEMA

    return spark.createDataFrame(rows, RULE_SCHEMA)


def dimension(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small table given in the program, as a local relation whose size the optimizer knows."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "strings": pa.list_(pa.string())}
    parts = list(zip(*rows)) or [[] for _ in columns]
    return spark.createDataFrame(pa.table({name: pa.array(list(v), kinds[kind]) for (name, kind), v in zip(columns.items(), parts)}))


def rule_rows(spark: SparkSession, enabled: bool = True) -> DataFrame:
    """The rule rows in the flat form that templates take, scopes as patterns."""
    none = "(?!)"
    flat = [
        (r[0], r[1], r[2], r[3], r[4], r[5], r[9], r[10], r[11], any_glob_regex(r[6]) or none, any_glob_regex(r[7]) or none, r[8])
        for r in RULES if not enabled or r[2] != "disabled"
    ]
    names = dict.fromkeys(("rule_id", "code", "mode", "severity", "intent", "kind", "regex", "needle"), "string")
    return dimension(spark, flat, names | {"most": "int", "include_re": "string", "exclude_re": "string", "require_files": "strings"})
