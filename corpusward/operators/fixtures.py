"""Fixture suites as a gate on rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import compile_rules
from .patterns import spans, stepped
from .scope import _small, in_scope


def run_fixtures(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(rule_id, case_name, path, code, kind, start_byte, end_byte): findings of all cases in one job.

    ``files`` has (rule_id, case_name, path, text); scope and required files hold inside a case.
    """
    sound = _small(compile_rules(rules).where("problem is null").select("rule_id", "code", "kind", "java", "steps", "empty", "include_re", "exclude_re", "require_files"))
    rows = files.join(sound, "rule_id")
    needed = files.select("rule_id", "case_name", "path").distinct()
    wanted = rows.select("rule_id", "case_name", F.explode("require_files").alias("path")).distinct()
    missing = wanted.join(needed, ["rule_id", "case_name", "path"], "left_anti").select("rule_id", "case_name").distinct()
    rows = rows.where(in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re"))).join(missing, ["rule_id", "case_name"], "left_anti")
    keys = ["rule_id", "case_name", "path", "code", "kind"]
    found = spans(rows.where(~F.col("empty") & F.rlike("text", "java")), F.col("java"), keys)
    if not sound.where("empty").isEmpty():
        found = found.unionByName(stepped(rows.where("empty and text is not null"), F.col("steps"), keys))
    return found.drop("ord", "text")


def compare_expected(actual: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """(rule_id, case_name, passed): exact-span expectations are met by distinct findings, and totals agree."""
    case, total = ["rule_id", "case_name"], ["rule_id", "case_name", "path", "code", "kind"]
    span = [*total, "start_byte", "end_byte"]
    have, want = actual.groupBy(*span).agg(F.count("*").alias("have")), expected.where("start_byte is not null").groupBy(*span).agg(F.count("*").alias("want"))
    exact = want.join(have, span, "left").where(F.col("want") > F.coalesce("have", F.lit(0))).select(*case)
    a, e = actual.groupBy(*total).agg(F.count("*").alias("have")), expected.groupBy(*total).agg(F.count("*").alias("want"))
    totals = a.join(e, total, "full").where(~F.col("have").eqNullSafe(F.col("want"))).select(*case)
    bad = exact.unionByName(totals).distinct().withColumn("_bad", F.lit(True))
    return cases.select(*case).distinct().join(bad, case, "left").select(*case, F.col("_bad").isNull().alias("passed"))


def fixture_gate(rules: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules that run, errors): a failing suite drops its rule."""
    failing = outcomes.where("not passed").select("rule_id").distinct()
    return rules.join(failing, "rule_id", "left_anti"), failing.withColumn("error", F.lit("fixtures_failed"))


def enforcement_evidence(rules: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule_id, has_positive, has_negative, enough): enforced rules need a case of each kind in scope."""
    rows = files.join(_small(rules.select("rule_id", "include_re", "exclude_re")), "rule_id")
    applies = rows.where(in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re"))).groupBy("rule_id", "case_name").agg(F.bool_or(F.col("text") != "").alias("nonempty"))
    positive = expected.select("rule_id", "case_name").distinct().withColumn("_positive", F.lit(True))
    cases = applies.join(positive, ["rule_id", "case_name"], "left").withColumn("_positive", F.coalesce("_positive", F.lit(False)))
    seen = cases.groupBy("rule_id").agg(F.bool_or("_positive").alias("p"), F.bool_or(~F.col("_positive") & F.col("nonempty")).alias("n"))
    out = rules.select("rule_id", "mode").join(seen, "rule_id", "left")
    p, n = F.coalesce("p", F.lit(False)), F.coalesce("n", F.lit(False))
    return out.select("rule_id", p.alias("has_positive"), n.alias("has_negative"), ((F.col("mode") != "enforced") | (p & n)).alias("enough"))
