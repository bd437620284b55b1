"""Detection templates: one job runs every rule row of a shape.

Rule rows are (rule_id, code, include_re, exclude_re, regex[, flags][, needle]); a rule with
several patterns or codes has several rows.  Patterns are in the rule language and are
translated here, with the flags (FLAGS, false where a column is missing).  Each distinct
translated pattern is evaluated once on the texts that some rule needs it for, and the
results fan out to the rules by an equality join, so adding rules that share patterns adds
no scans.  Rows with a pattern outside the language find nothing; :func:`pattern_errors`
names them, and the other rules are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from corpusward.functions.digest import CONTEXT, framed_digest, text_digest
from corpusward.functions.regexes import FLAGS as _JAVA_FLAGS
from corpusward.functions.regexes import compiled

from .patterns import LOCATED, group_of, lines, spans, stepped
from .scope import _small, in_scope, scope_join
from .spans import with_inside

RAW = ["rule_id", "path", "code", "start_byte", "end_byte"]
FLAGS = (*_JAVA_FLAGS, "crlf")


def whole_file(text: Column) -> list[Column]:
    return [F.lit(0).cast("long").alias("start_byte"), F.octet_length(text).cast("long").alias("end_byte")]


_COMPILED = StructType([StructField("java", StringType()), StructField("steps", StringType()), StructField("empty", BooleanType()), StructField("needs", StringType()), StructField("around", BooleanType()), StructField("n_groups", IntegerType()), StructField("problem", StringType())])


@F.udf(_COMPILED, useArrow=True)
def _compile(pattern: str, *flags: bool):
    try:
        return (*compiled(pattern, **{f: bool(on) for f, on in zip(FLAGS, flags)})[:6], None)
    except ValueError as problem:
        return (*[None] * 6, str(problem))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rules`` with two forms of their patterns and what is known of these.

    ``java`` and ``steps`` are the forms, ``empty`` says whether they can match without taking
    a character, ``needs`` is a literal that every match holds (or empty), ``around`` whether
    they look at what stands around a match, ``n_groups`` counts their groups, and ``problem`` says why a pattern is outside the language.
    """
    flags = [F.coalesce(F.col(f), F.lit(False)) if f in rules.columns else F.lit(False) for f in FLAGS]
    return rules.withColumn("_compiled", _compile(F.col("regex"), *flags)).select(*rules.columns, "_compiled.*")


def pattern_errors(rules: DataFrame) -> DataFrame:
    """(rule_id, error, detail) of rules that have a pattern outside the language."""
    return compile_rules(rules).where("problem is not null").select("rule_id", F.lit("invalid_pattern").alias("error"), F.col("problem").alias("detail")).distinct()


def _rows(rules: DataFrame, *more: str) -> DataFrame:
    """The sound rule rows with what evaluation needs and the columns ``more``, evaluated once.

    ``alone`` says that a pattern has one scope, so whatever it finds is inside that.
    """
    rows = compile_rules(rules).where("problem is null").select("rule_id", "include_re", "exclude_re", "java", "steps", "empty", "needs", "around", "n_groups", *more).distinct()
    scopes = F.collect_set(F.struct("include_re", "exclude_re")).over(Window.partitionBy("java"))
    return _small(rows.withColumn("alone", F.size(scopes) == 1))


def _texts(rows: DataFrame, corpus: DataFrame, stepping: bool, steps: str = "empty") -> DataFrame:
    """(path, text, java, steps) of every text and distinct pattern that finds something in it, in some scope.

    A pattern's scopes are tested together on the path, and before the text, in the scan; so a
    text is there once for each pattern that it is wanted for and is never shuffled.  ``steps``
    says which patterns are stepped through; the others, or these, are taken.
    """
    shape = rows.where(F.expr(steps) == stepping).groupBy("java", "steps", "needs", "empty", "n_groups").agg(F.collect_set(F.struct("include_re", "exclude_re")).alias("scopes"))
    wants = F.exists("scopes", lambda s: in_scope(F.col("path"), s["include_re"], s["exclude_re"]))
    # Looking for a literal is much cheaper than for a pattern.
    found = F.col("text").isNotNull() & (F.col("empty") | (F.contains("text", "needs") & F.rlike("text", "java")))
    return corpus.select("path", "text").join(_small(shape), wants & found).select("path", "text", "java", "steps", "n_groups")


def _steps(rows: DataFrame, steps: str = "empty") -> bool:
    """Whether some pattern must be stepped through."""
    return not rows.where(steps).isEmpty()


def _evaluated(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(path, java, ord, start_byte, end_byte, text): matches of each distinct pattern, in the scopes of any rule."""
    found = spans(_texts(rows, corpus, False), F.col("java"), ["path", "java"])
    if _steps(rows):
        found = found.unionByName(stepped(_texts(rows, corpus, True), F.col("steps"), ["path", "java"]))
    return found


def _fanned(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` for each rule row that has its pattern, inside the rule's scope; the path is tested where a pattern has several scopes."""
    both = found.join(rows.drop("steps", "empty", "needs", "around", "n_groups"), "java")
    return both.where(F.col("alone") | in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re"))).drop("alone")


def _matches(rules: DataFrame, corpus: DataFrame, *more: str) -> DataFrame:
    rows = _rows(rules, *more)
    return _fanned(_evaluated(rows, corpus), rows)


def shared_evaluation(rules: DataFrame, corpus: DataFrame, shared: bool = True) -> DataFrame:
    """(rule_id, path, ord, start_byte, end_byte, text): matches of every rule's regex in its scope.

    ``shared=False`` evaluates each rule by itself; the rows are the same.
    """
    columns = ["rule_id", "path", "ord", "start_byte", "end_byte", "text"]
    if shared:
        return _matches(rules, corpus).select(*columns)
    rows = _rows(rules)
    hits = corpus.select("path", "text").join(rows, in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re")))
    found = spans(hits.where(~F.col("empty") & F.rlike("text", "java")), F.col("java"), ["rule_id", "path"])
    if _steps(rows):
        found = found.unionByName(stepped(hits.where("empty and text is not null"), F.col("steps"), ["rule_id", "path"]))
    return found.select(*columns)


def detect_each(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """One finding for each match."""
    return _matches(rules, corpus, "code").select(*RAW)


def detect_located(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """:func:`detect_each` with LOCATED, matched_digest, file_digest and a file rule's context_digest.

    All of it comes from the scan that finds the matches; no text is joined to a finding.
    Of patterns that can match the empty text, the matches are joined to their texts.
    """
    rows = _rows(rules, "code")
    texts = _texts(rows, corpus, False).withColumn("file_digest", text_digest(F.col("text")))
    found = spans(texts, F.col("java"), ["path", "java", "file_digest"], located=True)
    if _steps(rows):
        from .findings import add_coordinates, add_snippet

        some = stepped(_texts(rows, corpus, True).withColumn("file_digest", text_digest(F.col("text"))), F.col("steps"), ["path", "java", "file_digest"])
        found = found.unionByName(add_snippet(add_coordinates(some.withColumnRenamed("text", "_match"), corpus), corpus).withColumnRenamed("_match", "text").select(*found.columns))
    found = found.withColumns({"matched_digest": text_digest(F.col("text")), "context_digest": framed_digest(CONTEXT, F.col("path"), F.col("file_digest"))})
    return _fanned(found, rows).select(*RAW, *LOCATED, "matched_digest", "file_digest", "context_digest")


def detect_each_where(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Matches whose own text contains the rule's needle."""
    return _matches(rules, corpus, "code", "needle").where(F.contains("text", "needle")).select(*RAW)


def _file_tests(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    return corpus.select("path", "text").join(rules, in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re")))


def detect_absence(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Files in scope without the pattern, as whole-file spans."""
    return _file_tests(_rows(rules, "code"), corpus).where(~F.rlike("text", "java")).select("rule_id", "path", "code", *whole_file(F.col("text")))


def detect_presence(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Files in scope that contain the needle, as whole-file spans."""
    return _file_tests(_small(rules), corpus).where(F.contains("text", "needle")).select("rule_id", "path", "code", *whole_file(F.col("text")))


def detect_lines(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Lines in which the pattern is found."""
    rows = _rows(rules, "code")
    # Anchors may hold in a line that do not hold in the whole text, so the whole text is no test of those.
    shape = _small(rows.groupBy("java", "needs", "around").agg(F.collect_set(F.struct("include_re", "exclude_re")).alias("scopes")))
    wants = F.exists("scopes", lambda s: in_scope(F.col("path"), s["include_re"], s["exclude_re"]))
    texts = corpus.select("path", "text").join(shape, wants & F.contains("text", "needs") & (F.col("around") | F.rlike("text", "java"))).select("path", "text", "java", "needs")
    return _fanned(lines(texts, ["path", "java", "needs"]).where(F.contains("text", "needs") & F.rlike("text", "java")).drop("needs"), rows).select(*RAW)


def detect_capture_compare(rules: DataFrame, corpus: DataFrame, equal: bool = True) -> DataFrame:
    """Matches whose first two groups are equal (or, with ``equal=False``, differ); absent equals absent."""
    rows, outside = _rows(rules, "code"), "empty or around"
    # The first two groups of a match come from the match alone, unless the pattern looks around it.
    texts = _texts(rows, corpus, False, outside)
    groups = [F.when(F.col("n_groups") >= k, group_of(F.col("text"), F.col("java"), k)).alias(f"g{k}") for k in (1, 2)]
    found = spans(texts, F.col("java"), ["path", "java", "n_groups"]).select("path", "java", "start_byte", "end_byte", *groups)
    if _steps(rows, outside):
        more = stepped(_texts(rows, corpus, True, outside), F.col("steps"), ["path", "java"], groups=[("g1", 1), ("g2", 2)])
        found = found.unionByName(more.select("path", "java", "start_byte", "end_byte", *[F.col("groups")[g].alias(g) for g in ("g1", "g2")]))
    same = F.col("g1").eqNullSafe(F.col("g2"))
    return _fanned(found.where(same if equal else ~same), rows).select(*RAW)


def detect_enclosed(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Matches inside a match of the rule's ``outer_regex``, or outside all of them where ``within`` is false.

    Rules either of whose patterns is outside the language find nothing.
    """
    outer_rules = rules.withColumn("regex", F.col("outer_regex"))
    sound = _small(compile_rules(outer_rules).groupBy("rule_id").agg(F.max("problem").alias("problem")).where("problem is null").select("rule_id"))
    found = _matches(rules.join(sound, "rule_id", "left_semi"), corpus, "code", "within").select(*RAW, "within")
    return with_inside(found, _matches(outer_rules, corpus), ["rule_id", "path"]).where("is_inside = within").select(*RAW)


def detect_count(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Files with more matches than the rule's ``most``, as (rule_id, path, n_matches)."""
    found = _matches(rules, corpus, "most").groupBy("rule_id", "path", "most").agg(F.count("*").alias("n_matches"))
    return found.where("n_matches > most").select("rule_id", "path", "n_matches")


def defined_twice(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Across files: matches whose text is found in more than one file of the rule's scope."""
    found = _matches(rules, corpus, "code")
    files = found.select("rule_id", "text", "path").distinct().groupBy("rule_id", "text").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(files.select("rule_id", "text"), ["rule_id", "text"]).select(*RAW)


def used_undefined(uses: DataFrame, defines: DataFrame, corpus: DataFrame) -> DataFrame:
    """Across files: matches of the use rules whose text no define rule of the same code finds anywhere."""
    defined = _matches(defines, corpus, "code").select("code", "text").distinct()
    return _matches(uses, corpus, "code").join(defined, ["code", "text"], "left_anti").select(*RAW)


def repository_gap_guard(raw: DataFrame, rules: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): cross-file rules with a gap in their scope give an error and no findings."""
    touched = scope_join(rules, gaps).select("rule_id").distinct()
    return raw.join(touched, "rule_id", "left_anti"), touched.withColumn("error", F.lit("source_gap"))


def detect_each_within(rules: DataFrame, corpus: DataFrame, per_call: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): :func:`detect_each`, but a pattern with more than ``per_call`` matches in a text fails.

    A failed (rule, path) has no finding, and is a row of errors.  A text is searched up to
    one match beyond the limit before its matches are listed, so one with millions costs the limit;
    only matches of patterns that can match the empty text are stepped through and counted.
    """
    rows = _rows(rules, "code")
    texts = _texts(rows, corpus, False)
    over = F.size(F.split(F.col("text"), F.col("java"), per_call + 2)) > per_call + 1
    found, failed = spans(texts.where(~over), F.col("java"), ["path", "java"]), texts.where(over).select("path", "java")
    if _steps(rows):
        some = stepped(_texts(rows, corpus, True), F.col("steps"), ["path", "java"])
        many = some.groupBy("path", "java").agg(F.count("*").alias("n")).where(F.col("n") > per_call).select("path", "java")
        found, failed = found.unionByName(some.join(many, ["path", "java"], "left_anti")), failed.unionByName(many)
    errors = _fanned(failed, rows).select("rule_id", "path", F.lit("match_limit").alias("error")).distinct()
    return failed_invocations(_fanned(found, rows).select(*RAW), errors), errors


def enforce_limits(raw: DataFrame, per_rule_file: int) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): a (rule, path) over the limit loses all its findings and is an error."""
    counts = raw.groupBy("rule_id", "path").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") > per_rule_file)
    return raw.join(over, ["rule_id", "path"], "left_anti"), over.select("rule_id", "path", F.lit("diagnostic_limit").alias("error"))


def failed_invocations(raw: DataFrame, errors: DataFrame) -> DataFrame:
    """Findings of the (rule, path) pairs that did not fail."""
    return raw.join(errors.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_anti")


def dedup_order(raw: DataFrame) -> DataFrame:
    """Exact duplicates dropped; ordered by path, span, rule and code."""
    return raw.dropDuplicates(RAW).orderBy("path", "start_byte", "end_byte", "rule_id", "code")


def preview_rules(rules: DataFrame, corpus: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """Findings of rule rows that are not installed, under ``candidate/`` ids that take no decisions.

    ``passing`` holds the ids whose fixtures passed; others do not run.  No ledger is joined.
    """
    renamed = rules.withColumn("rule_id", F.concat(F.lit("candidate/"), F.substring_index("rule_id", "/", -1)))
    if passing is not None:
        ids = passing.select(F.concat(F.lit("candidate/"), F.substring_index("rule_id", "/", -1)).alias("rule_id"))
        renamed = renamed.join(ids, "rule_id", "left_semi")
    return detect_each(renamed, corpus).withColumns({"partial": F.lit(True), "reviewable": F.lit(False)})


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "Window", "F")]
