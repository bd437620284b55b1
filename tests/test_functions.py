"""Digests, globs, patterns and text operators on small cases."""

import random

import duckdb
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusward.functions import text as t
from corpusward.functions.digest import RECORD, framed_digest
from corpusward.functions.globs import glob_regex
from corpusward.functions.regexes import compiled, java_pattern, required_literal, solid_pattern, stepping_pattern
from corpusward.operators import detect, patterns
from corpusward.operators.findings import add_identity


def test_pinned_digests(spark):
    row = spark.createDataFrame(
        [("local/vector", "hit", "src/a.txt", 0, 3, *("sha256:" + str(k) * 64 for k in range(5)))],
        "rule_id string, code string, path string, start_byte long, end_byte long, matched_digest string, rule_digest string, file_digest string, context_digest string, engine_digest string",
    )
    got = add_identity(row).first()
    assert got.finding_id == "sha256:109740956a93be6e9d49fe92d252a3494bd0ddaa1d8937357c5a3ca5cbfa9a0f"
    assert got.evidence_digest == "sha256:02eacd4c8a1a066d526eca74010b3846f21079f4d109c9b3c69d36cf5d24878b"
    record = spark.range(1).select(framed_digest(RECORD, F.lit('{"schema_version":1}'), F.lit("# Reviewed\n")).alias("d")).first().d
    assert record == "sha256:33d87a000036666295070847b760e97e496d2672ed2ed0a2d730982ce4b900dc"


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("**/*.txt", "a.txt", True), ("**/*.txt", "d/e/a.txt", True), ("d/**", "d/e/a", True),
        ("d/**", "d", False), ("?.txt", "ab.txt", False), ("[a-c].txt", "b.txt", True), ("[!a-c].txt", "b.txt", False), ("[!a]x", "/x", False),
        ("{a,b*}/c", "bxx/c", True), ("a.b", "axb", False), ("A.txt", "a.txt", False), ("a**b", "a/b", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(glob_regex(glob)).alias("x")).first().x is hit


def test_patterns_outside_the_language_are_refused():
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "(?>a)", "a{2,1}", "(?P<a>x)(?P<a>y)", r"\p{Nope}", r"(?-u:\W)", "[z-a]", "a{", "*a", "[a", "(a", "a)", r"\q"):
        with pytest.raises(ValueError):
            java_pattern(bad)
    assert java_pattern("a$") == "a\\z"
    with pytest.raises(ValueError):
        java_pattern("a", unknown=True)


def test_spans_are_bytes_and_lines_count_from_lf(spark):
    df = spark.createDataFrame([("p", "é foo\r\nfoo é foo"), ("q", ""), ("r", None)], "path string, text string")
    found = patterns.find_all(df, "foo").orderBy("start_byte").collect()
    assert [(x.ord, x.start_byte, x.end_byte) for x in found] == [(0, 3, 6), (1, 8, 11), (2, 15, 18)]
    rows = patterns.lines(df).orderBy("path", "line_no").collect()
    assert [(x.path, x.line_no, x.start_byte, x.end_byte, x.text) for x in rows] == [("p", 1, 0, 6, "é foo"), ("p", 2, 8, 18, "foo é foo")]


def test_last_line_without_lf_keeps_its_cr(spark):
    df = spark.createDataFrame([("p", "a\r\nb\r")], "path string, text string")
    assert [x.text for x in patterns.lines(df).orderBy("line_no").collect()] == ["a", "b\r"]
    ended = spark.createDataFrame([("p", "a\n")], "path string, text string")
    assert patterns.lines(ended).count() == 1


def test_zero_width_matches_advance(spark):
    df = spark.createDataFrame([("p", "a12b")], "path string, text string")
    got = [(x.start_byte, x.end_byte) for x in patterns.find_all(df, "[0-9]*").orderBy("ord").collect()]
    assert got == [(0, 0), (1, 3), (4, 4)]


def test_groups_and_captures(spark):
    df = spark.createDataFrame([("p", "k=v; j="), ("q", "none")], "path string, text string")
    rows = patterns.find_all(df, "(?P<key>[a-z])=(?P<value>[a-z])?", groups=True).orderBy("ord").collect()
    assert [r.groups for r in rows] == [{"key": "k", "value": "v"}, {"key": "j", "value": None}]
    got = {r.path: r.captured for r in patterns.capture_text(df, "(?P<key>[a-z])=").collect()}
    assert got == {"p": "k=", "q": None}


def test_text_operators(spark):
    row = spark.createDataFrame([("aaa", "　 x　\n", None)], "a string, b string, c string")
    got = row.select(
        t.replace(F.col("a"), "aa", "b").alias("r"), t.trim(F.col("b")).alias("t"), t.same(F.col("c"), F.lit(None)).alias("n"), t.contains(F.col("a"), F.lit("")).alias("e"),
        t.checked("/", F.lit(-7), F.lit(2)).alias("d"), t.checked("%", F.lit(-7), F.lit(2)).alias("m"), t.checked("+", F.lit(2**63 - 1), F.lit(1), "null").alias("o"), t.checked("/", F.lit(1), F.lit(0), "null").alias("z"),
    ).first()
    assert (got.r, got.t, got.n, got.e, got.d, got.m, got.o, got.z) == ("ba", "x", True, True, -3, -1, None, None)
    for bad in (lambda: t.split_literal(F.col("a"), ""), lambda: t.replace(F.col("a"), "", "x")):
        with pytest.raises(ValueError):
            bad()


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(t.checked("+", F.lit(2**63 - 1), F.col("id") + 1)).collect()


def test_offsets_of_many_matches(spark):
    for n in (1, 63, 64, 65, 1000):
        df = spark.createDataFrame([("p", "é-x" * n)], "path string, text string")
        got = [(r.start_byte, r.end_byte) for r in patterns.find_all(df, "x").orderBy("ord").collect()]
        assert got == [(4 * k + 3, 4 * k + 4) for k in range(n)]


@pytest.mark.parametrize(("pattern", "literal"), [
    ("[Ll]icen[sc]e", "icen"), ("abc", "abc"), ("a|b", ""), ("ab?c", "a"), ("ab*cd", "cd"), ("ab+cd", "bcd"), ("ab{0,2}c", "a"), ("(abc)?x", "x"), ("x(?:abc)y", "xabcy"), ("[.]", "."), ("a[.]b", "a.b"),
    ("\\.txt$", ".txt"), ("\\w+@[a-z]+[.]com", ".com"), ("(?i)abc", ""), ("[^a]b", "b"), ("a(b|c)dd", "dd"), ("\\p{Lu}xy", "xy"), ("a??bc", "bc"), ("[[:alpha:]]q", "q"), ("[a&&[b]]c", "c"), ("x\\x{41}yyy", "xAyyy"), ("é+é?", "é"), ("", ""),
])
def test_literals_that_every_match_holds(pattern, literal):
    assert required_literal(pattern) == literal
    assert not any(c.isalpha() for c in required_literal(pattern, case_insensitive=True))


#: Pattern, text and the byte spans of its matches.
LANGUAGE = [
    ("[[:digit:]]+", "12 dig", [(0, 2)]), ("\\pL+", "abc 12", [(0, 3)]), ("(?m)b$", "ab\ncb", [(1, 2), (4, 5)]), ("b$", "ab\ncb", [(4, 5)]), ("[a-z--b]+", "abc", [(0, 1), (2, 3)]), ("\\x{41}+", "xAAx", [(1, 3)]),
    ("[]$]+", "a]$b", [(1, 3)]), ("\\u{41}b", "Ab", [(0, 2)]), ("\\p{Greek}+", "aβγ", [(1, 5)]), ("(?P<my_name>good)", "good", [(0, 4)]), ("a++", "caab", [(1, 3)]), ("(?:a{2}){2}", "aaaaa", [(0, 4)]),
    ("(?i)k+", "kK\u212ai\u0131", [(0, 5)]), ("(?i)i+", "iI\u0131", [(0, 2)]), ("(?i)straße", "STRAẞE", [(0, 8)]), ("(?i)[^a]+", "aAb", [(2, 3)]), ("(?i)\\p{Lu}+", "aB1", [(0, 2)]), ("a(?i)b(?-i)c", "aBc aBC", [(0, 3)]),
    ("(?i:a)b", "Ab AB", [(0, 2)]), ("(?x) a \\  b # c\n [ c d ]", "a bd", [(0, 4)]), ("\\bé", "é xé", [(0, 2)]), ("(?-u:\\b)x", "éx", [(2, 3)]), ("\\<a|a\\>", "aba", [(0, 1), (2, 3)]), ("\\b{start}a", "aa a", [(0, 1), (3, 4)]),
    ("(?s).b", "\nb", [(0, 2)]), (".b", "\nbab", [(2, 4)]), ("(?m)^a", "a\ra\na", [(0, 1), (4, 5)]), ("(?mR)^a", "a\ra\r\na", [(0, 1), (2, 3), (5, 6)]), ("(?mR)a$", "a\ra\r\na", [(0, 1), (2, 3), (5, 6)]), ("(?R).+", "a\rb", [(0, 1), (2, 3)]),
    ("(?U)a+", "aaa", [(0, 1), (1, 2), (2, 3)]), ("[\\w&&[^a-y]]+", "azzéb", [(1, 5)]), ("[a-f~~d-h]+", "abdegh", [(0, 2), (4, 6)]), ("[[:^alpha:]]+", "a1-b", [(1, 3)]), ("[a-]+", "-a", [(0, 2)]), ("[-a]+", "-a", [(0, 2)]),
    ("[[a-c][x-z]]+", "axq", [(0, 2)]), ("\\pN\\PN", "1a", [(0, 2)]), ("\\p{gc=Lu}\\P{L}", "A1", [(0, 2)]), ("\\p{Lu}\\p{Lowercase_Letter}", "Ab", [(0, 2)]), ("[^\\d\\s]+", "1 a", [(2, 3)]), ("\\d+", "1٣", [(0, 3)]), ("(?-u:\\d)+", "1٣", [(0, 1)]),
    ("\\Aa|b\\z", "aab\n", [(0, 1)]), ("x*?y", "xxy", [(0, 3)]), ("\\.\\$\\#\\-\\&", ".$#-&", [(0, 5)]), ("a{2,3}?", "aaa", [(0, 2)]), ("[\\x00-\\x7F]+", "aé", [(0, 1)]), ("(?P<a.b[0]>x)", "x", [(0, 1)]), ("a|b|[c-e]", "abe", [(0, 1), (1, 2), (2, 3)]),
    ("\\t\\n\\v\\f\\a", "\t\n\x0b\x0c\x07", [(0, 5)]), ("[\\]\\[^&]+", "][&", [(0, 3)]), ("}]", "}]", [(0, 2)]), ("(a|bc)+?d", "abcd", [(0, 4)]), ("\\p{Script=Han}", "漢a", [(0, 3)]),
]


def test_the_pattern_language(spark):
    """Every case natively or, where it can match nothing, by steps; and all of them by steps."""
    rows = spark.createDataFrame([(f"r/{k}", "c", p, "^t{}$".replace("{}", str(k)), "(?!)") for k, (p, _, _) in enumerate(LANGUAGE)], "rule_id string, code string, regex string, include_re string, exclude_re string")
    texts = spark.createDataFrame([(f"t{k}", t) for k, (_, t, _) in enumerate(LANGUAGE)], "path string, text string")
    got = {}
    for r in detect.detect_each(rows, texts).collect():
        got.setdefault(r.rule_id, []).append((r.start_byte, r.end_byte))
    assert {k: sorted(got.get(f"r/{k}", [])) for k in range(len(LANGUAGE))} == {k: spans for k, (_, _, spans) in enumerate(LANGUAGE)}
    steps = [(f"t{k}", t, stepping_pattern(p)) for k, (p, t, _) in enumerate(LANGUAGE)]
    got = {}
    for r in patterns.stepped(spark.createDataFrame(steps, "path string, text string, p string"), F.col("p"), ["path"]).collect():
        got.setdefault(r.path, []).append((r.start_byte, r.end_byte))
    assert {k: sorted(got.get(f"t{k}", [])) for k in range(len(LANGUAGE))} == {k: spans for k, (_, _, spans) in enumerate(LANGUAGE)}


def random_pattern(rng, depth=0):
    """A pattern that RE2 reads alike."""
    atoms = ["a", "b", "c", "ab", "[ab]", "[^a]", "[b-d]", "[[:alpha:]]", "[^[:digit:]]", ".", "\\d", "\\w", "\\.", "\\x{61}", "\\pL", "\\p{Lu}", "(?i:aB)", "(?s:.)"]
    places = ["^", "$", "\\b", "\\B", "\\A", "\\z", "(?m:^)", "(?m:$)"]
    kind = rng.randrange(10)
    if depth > 3 or kind < 3:
        return rng.choice(atoms)
    if kind == 3:
        return rng.choice(places) + rng.choice(atoms)
    if kind < 6:
        return random_pattern(rng, depth + 1) + random_pattern(rng, depth + 1)
    if kind == 6:
        return f"({random_pattern(rng, depth + 1)}|{random_pattern(rng, depth + 1)})"
    if kind == 7:
        return f"(?P<n{rng.randrange(10**6)}>{random_pattern(rng, depth + 1)})"
    return f"(?:{random_pattern(rng, depth + 1)}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '+?', '??'])}"


def test_translated_patterns_equal_an_independent_engine(spark):
    """Matches of 400 random patterns on random texts, as RE2 finds them."""
    rng, con = random.Random(5), duckdb.connect()
    rules, texts, want = [], [], {}
    while len(rules) < 400:
        pattern, text = random_pattern(rng), "".join(rng.choice("aabbcdAB1. \n") for _ in range(rng.randrange(1, 14)))
        if compiled(pattern).empty:
            continue
        k = len(rules)
        rules.append((f"r/{k}", "c", pattern, f"^t{k}$", "(?!)"))
        texts.append((f"t{k}", text))
        if found := con.execute("select regexp_extract_all(?, ?)", [text, pattern]).fetchone()[0]:
            want[f"r/{k}"] = sorted(found)
    got = {}
    for r in detect.shared_evaluation(spark.createDataFrame(rules, "rule_id string, code string, regex string, include_re string, exclude_re string"), spark.createDataFrame(texts, "path string, text string")).collect():
        got.setdefault(r.rule_id, []).append(r.text)
    odd = {k: (rules[int(k[2:])][2], texts[int(k[2:])][1], want.get(k), got.get(k)) for k in want.keys() | got.keys() if want.get(k) != sorted(got.get(k, []))}
    assert not odd and len(want) > 100


def test_one_bad_rule_stops_no_other(spark):
    rows = [("r/good", "good"), ("r/script", "\\p{Greek}+"), ("r/named", "(?P<my_name>good)"), *[(f"r/bad{k}", p) for k, p in enumerate(["(", "\\p{Nope}", "(?=x)", "a{9}{2", "[z-a]"])]]
    rules = spark.createDataFrame([(i, "c", p, "^", "(?!)") for i, p in rows], "rule_id string, code string, regex string, include_re string, exclude_re string")
    found = detect.detect_each(rules, spark.createDataFrame([("t", "good")], "path string, text string")).collect()
    assert sorted(r.rule_id for r in found) == ["r/good", "r/named"]
    assert sorted(r.rule_id for r in detect.pattern_errors(rules).collect()) == [f"r/bad{k}" for k in range(5)]


def test_groups_are_those_of_the_match(spark):
    """Groups that take no part are absent, and places around a match count."""
    cases = [("\\B([a-z])([a-z])", "xab", 0), ("x(a)?(b*)y", "xy", 0), ("([a-z])([a-z])", "aab", 1), ("x(a)?(b)?y", "xy", 1), ("(a)", "a", 0), ("b", "b", 1), ("(a|)(b|)c", "c", 1), ("([a-z]+) ([a-z]+)\\b", "so so", 1)]
    rules = spark.createDataFrame([(f"r/{k}", "c", p, f"^t{k}$", "(?!)") for k, (p, _, _) in enumerate(cases)], "rule_id string, code string, regex string, include_re string, exclude_re string")
    texts = spark.createDataFrame([(f"t{k}", t) for k, (_, t, _) in enumerate(cases)], "path string, text string")
    got = [r.rule_id for r in detect.detect_capture_compare(rules, texts).collect()]
    assert {k: got.count(f"r/{k}") for k in range(len(cases))} == {k: n for k, (_, _, n) in enumerate(cases)}
    assert detect.detect_capture_compare(rules, texts, equal=False).where("rule_id = 'r/0'").count() == 1


def test_first_match_is_the_first_of_all(spark):
    df = spark.createDataFrame([("p", "abba"), ("q", "bb"), ("r", ""), ("s", None)], "path string, text string")
    for pattern in ("b*", "b+", "b*$"):
        want = {r.path: (r.start_byte, r.end_byte, r.text) for r in patterns.find_all(df, pattern).where("ord = 0").collect()}
        assert {r.path: (r.start_byte, r.end_byte, r.text) for r in patterns.first_match(df, pattern).collect()} == want


def one_by_one(pattern, text):
    """Matches by one search after the other; an empty one next to the match before it does not count."""
    find, at, last, found = regex.compile(stepping_pattern(pattern)), 0, -1, []
    while at <= len(text) and (m := find.search(text, at)):
        if m.start() == m.end() == last:
            at += 1
            continue
        found.append(tuple(len(text[:k].encode()) for k in m.span()))
        at = last = m.end()
    return found


def test_empty_matches_are_filled_in(spark):
    """Random patterns that can match the empty text, as single searches find them; many need no step for each place."""
    rng = random.Random(6)
    texts = ["", "é", "aé😀b", "aabé", *["".join(rng.choice("aabbcdAB1. é😀\n") for _ in range(rng.randrange(1, 14))) for _ in range(8)]]
    rows, want, n_solid = [], {}, 0
    found = ["a*", "a*?", "(?:ab)*|c", "|a", "(a|b*)c?", "a?b?", "(?:a|bc){0,2}", "(?:a*)*", "a*(?:b|$)?", "\\p{Lu}*", "[^[:digit:]]*", "(?i)b*", "a{0}", "(?:)"]
    while len(found) < 150:
        if compiled(p := random_pattern(rng)).empty and not compiled(p).around:
            found.append(p)
    for k, p in enumerate(found):
        n_solid += solid_pattern(stepping_pattern(p)) is not None
        for i, t in enumerate(texts):
            rows.append((f"{k}/{i}", t, stepping_pattern(p)))
            want[f"{k}/{i}"] = one_by_one(p, t) if solid_pattern(stepping_pattern(p)) else None
    got = {}
    for r in patterns.stepped(spark.createDataFrame(rows, "path string, text string, p string"), F.col("p"), ["path"]).orderBy("path", "ord").collect():
        own = got.setdefault(r.path, [])
        assert r.ord == len(own) and r.text.encode() == texts[int(r.path.split("/")[1])].encode()[r.start_byte : r.end_byte]
        own.append((r.start_byte, r.end_byte))
    odd = {k: (found[int(k.split("/")[0])], texts[int(k.split("/")[1])], v, got.get(k, [])) for k, v in want.items() if v is not None and v != got.get(k, [])}
    assert not odd and n_solid > 100


def test_batches_of_matches_are_bounded():
    """No batch holds the matches of all texts, or all of one long text; of first matches a text has one row."""
    texts = pa.array(["ab" * 40_000 + "1" * 70_000 + "é"] + ["x" * 500] * 1000)
    sizes = {}
    for pattern in ("(?V1)[0-9]*", "(?V1)(?:[0-9]|(?![^\\n]))*"):
        batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(1001))), texts, pa.array([pattern] * 1001)], ["path", "text", "_pattern"])
        for first in (False, True):
            sizes[pattern, first] = [b.num_rows for b in patterns._stepping(iter([batch]), ["path"], None, first)]
    assert max(map(max, sizes.values())) <= 2 * patterns.STEPPED_ROWS
    assert [sum(n) for n in sizes.values()] == [80_000 + 2 + 501 * 1000, 1001] * 2


def test_first_match_makes_no_other_rows(spark):
    """What the tasks return is the result: no row of a later match leaves them to be filtered."""
    df = spark.createDataFrame([("p", "abba" * 1000), ("q", "éabb"), ("r", "")], "path string, text string")
    first = patterns.first_match(df, "b*")
    assert "Filter" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, first.collect())) == [("p", 0, 0, ""), ("q", 0, 0, ""), ("r", 0, 0, "")]
