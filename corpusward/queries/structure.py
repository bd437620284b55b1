"""Queries of spans, markup and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.operators import markup, records, spans
from corpusward.operators.patterns import find_all

from .base import PAGES_SQL, pages, query, spans_sql, table

_NAV, _LINK, _ART = "<nav>.*?</nav>", "<a [^>]*>", "<article>(?:[^<]|<[^/]|</[^a]|</a>)*</article>"
_SPANS = f"WITH {PAGES_SQL}, nav AS ({spans_sql('path', 'pages_', repr(_NAV))}), link AS ({spans_sql('path', 'pages_', repr(_LINK))}), para AS ({spans_sql('path', 'pages_', repr('<b>|<p>'))})"


def _three(spark, sf_dir):
    p = pages(spark, sf_dir)
    return find_all(p, _NAV), find_all(p, _LINK), find_all(p, "<b>|<p>")


@query(f"{_SPANS} SELECT path, nav.start_byte AS outer_start, nav.end_byte AS outer_end, link.start_byte, link.end_byte FROM nav JOIN link USING (path) WHERE link.start_byte >= nav.start_byte AND link.end_byte <= nav.end_byte")
def f1_span_contains(spark, sf_dir):
    nav, link, _ = _three(spark, sf_dir)
    return spans.span_contains(nav, link)


@query(f"""{_SPANS}, marks AS (SELECT * FROM link UNION ALL SELECT * FROM para)
SELECT path, start_byte, end_byte, EXISTS (SELECT 1 FROM nav WHERE nav.path = marks.path AND marks.start_byte >= nav.start_byte AND marks.end_byte <= nav.end_byte) AS is_inside FROM marks""")
def f2_inside_outside(spark, sf_dir):
    nav, link, para = _three(spark, sf_dir)
    marks = link.unionByName(para)
    part = lambda d, v: d.select("path", "start_byte", "end_byte", F.lit(v).alias("is_inside"))
    return part(spans.inside(marks, nav), True).unionByName(part(spans.outside(marks, nav), False))


@query(f"{_SPANS} SELECT path, start_byte, end_byte FROM nav WHERE NOT EXISTS (SELECT 1 FROM para WHERE para.path = nav.path AND para.start_byte >= nav.start_byte AND para.end_byte <= nav.end_byte)")
def f3_without_inner(spark, sf_dir):
    nav, _, para = _three(spark, sf_dir)
    return spans.without_inner(nav, para).select("path", "start_byte", "end_byte")


@query(f"""WITH {PAGES_SQL}, e AS ({spans_sql('path', 'pages_', repr('<li>.*?</li>'))})
SELECT path, CAST(ord AS INTEGER) AS ord, start_byte, end_byte, start_byte + 4 AS inner_start, end_byte - 5 AS inner_end FROM e""")
def f4_elements(spark, sf_dir):
    return markup.elements(pages(spark, sf_dir), "li").select("path", "ord", "start_byte", "end_byte", "inner_start", "inner_end")


@query(f"""WITH {PAGES_SQL}, a AS ({spans_sql('path', 'pages_', repr('<a href="[^"]*">.*?</a>'))}), li AS ({spans_sql('path', 'pages_', repr('<li>.*?</li>'))})
SELECT a.path, a.start_byte, a.end_byte, li.start_byte AS outer_start, li.end_byte AS outer_end, regexp_extract(a.text, 'href="([^"]*)"', 1) AS href
FROM a JOIN li ON a.path = li.path AND a.start_byte >= li.start_byte AND a.end_byte <= li.end_byte""")
def f5_match_in_context(spark, sf_dir):
    p = pages(spark, sf_dir)
    child = markup.attribute(markup.elements(p, "a"), "href")
    return markup.match_in_context(child, markup.elements(p, "li")).select("path", "start_byte", "end_byte", "outer_start", "outer_end", "href")


@query(f"WITH {PAGES_SQL}, e AS ({spans_sql('path', 'pages_', repr('<h1>.*?</h1>'))}) SELECT path, ord, start_byte + 4 AS start_byte, end_byte - 5 AS end_byte FROM e")
def f6_node(spark, sf_dir):
    return markup.node(markup.elements(pages(spark, sf_dir), "h1"))


@query(f"""WITH {PAGES_SQL}, nav AS ({spans_sql('path', 'pages_', repr(_NAV))}), w AS ({spans_sql('path', 'pages_', repr('href="/[A-Z][a-z]*"'))})
SELECT w.path, w.start_byte, w.end_byte, w.text FROM w JOIN nav ON w.path = nav.path AND w.start_byte >= nav.start_byte AND w.end_byte <= nav.end_byte""")
def f7_nested_search(spark, sf_dir):
    p = pages(spark, sf_dir)
    return markup.nested_search(p, markup.elements(p, "nav"), 'href="/[A-Z][a-z]*"').select("path", "start_byte", "end_byte", "text")


_COUNT = lambda tag: f"len(regexp_extract_all(text, '<{tag}( [^>]*)?>')) <> len(regexp_extract_all(text, '</{tag}>'))"


@query(f"""WITH {PAGES_SQL}, x AS (SELECT path, concat_ws(',', CASE WHEN {_COUNT('body')} THEN 'body' END, CASE WHEN {_COUNT('footer')} THEN 'footer' END, CASE WHEN {_COUNT('html')} THEN 'html' END) AS unclosed FROM pages_)
SELECT path, 'parse_error' AS reason, unclosed FROM x WHERE unclosed <> ''""")
def f8_structure_gaps(spark, sf_dir):
    return markup.structure_gaps(pages(spark, sf_dir), ["body", "footer", "html"])


def _events(spark, sf_dir):
    """events with props as they are, cut short, or as arrays and other shapes, by their ids."""
    k, p = F.col("event_id") % 5, F.col("props")
    value = (
        F.when(k == 1, F.substring(p, F.lit(1), F.length(p) - 1)).when(k == 2, F.concat(F.lit("["), p, F.lit(","), F.col("user_id").cast("string"), F.lit("]")))
        .when(k == 3, F.concat(F.lit('{"n":'), p, F.lit(',"s":"'), F.col("event_type"), F.lit('","f":1.5,"b":true}'))).otherwise(p)
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", value.alias("body"))


_EVENTS = """e AS (SELECT event_id, user_id, event_type, event_id % 5 AS k, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS v, props FROM events)"""


@query(f"WITH {_EVENTS} SELECT event_id, CASE WHEN k = 1 THEN 'parse_error' END AS reason FROM e")
def f9_parse_records(spark, sf_dir):
    return records.parse_records(_events(spark, sf_dir), "body").select("event_id", "reason")


@query(f"WITH {_EVENTS} SELECT event_id, CASE WHEN k IN (0, 4) THEN v END AS direct, CASE WHEN k = 3 THEN v END AS deep FROM e")
def f10_get(spark, sf_dir):
    r = records.parse_records(_events(spark, sf_dir), "body")
    return r.select("event_id", records.get(F.col("record"), "k", as_type="long").alias("direct"), records.get(F.col("record"), "n", "k", as_type="long").alias("deep"))


@query(f"""WITH {_EVENTS} SELECT event_id, 'k' AS key, 'integer' AS kind FROM e WHERE k IN (0, 4)
UNION ALL SELECT event_id, key, kind FROM e, (VALUES ('n', 'object'), ('s', 'string'), ('f', 'float'), ('b', 'boolean')) t(key, kind) WHERE k = 3""")
def f11_entries(spark, sf_dir):
    r = records.entries(records.parse_records(_events(spark, sf_dir), "body"), "record")
    return r.select("event_id", "key", records.kind(F.col("value")).alias("kind"))


@query(f"WITH {_EVENTS} SELECT event_id, pos, CASE pos WHEN 0 THEN 'object' ELSE 'integer' END AS kind, CASE pos WHEN 1 THEN user_id END AS value FROM e, (VALUES (0), (1)) t(pos) WHERE k = 2")
def f12_items(spark, sf_dir):
    r = records.items(records.parse_records(_events(spark, sf_dir), "body"), "record")
    return r.select("event_id", "pos", records.kind(F.col("value")).alias("kind"), F.when(F.col("pos") == 1, F.try_variant_get("value", "$", "long")).alias("value"))


@query(f"WITH {_EVENTS} SELECT event_id, CASE k WHEN 2 THEN 'array' ELSE 'object' END AS kind, CASE WHEN k = 3 THEN event_type END AS s_text, CASE WHEN k = 3 THEN 'true' END AS b_text FROM e WHERE k <> 1")
def f13_kind_text(spark, sf_dir):
    r = records.parse_records(_events(spark, sf_dir), "body").where("reason is null")
    s, b = records.get(F.col("record"), "s"), records.get(F.col("record"), "b")
    return r.select("event_id", records.kind(F.col("record")).alias("kind"), records.text_of(s).alias("s_text"), records.text_of(b).alias("b_text"))


@query("""WITH e AS (SELECT event_id, unnest(['click', 'extra', 'x' || (user_id % 4)]) AS key, event_type FROM events)
SELECT event_id, key, CASE WHEN key = 'extra' THEN event_type ELSE key END AS name FROM e WHERE CASE WHEN key = 'extra' THEN event_type ELSE key END NOT IN ('click', 'x0', 'x1')""")
def f14_allowlist_entries(spark, sf_dir):
    body = F.concat(F.lit('{"deps":{"click":1,"extra":{"as":"'), F.col("event_type"), F.lit('"},"x'), (F.col("user_id") % 4).cast("string"), F.lit('":null}}'))
    rows = records.parse_records(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")
    allowed = spark.createDataFrame([("click",), ("x0",), ("x1",)], "name string")
    return records.allowlist_entries(rows, "record", "deps", allowed, "as").select("event_id", "key", "name")
