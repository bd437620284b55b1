"""Rule tables: the dimension side of every check.

A rule is a row (rule_id, mode, severity, execution, intent, scope, patterns, diagnostics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.digest import PACKAGE, framed_digest, framed_list_digest

RULE_SCHEMA = (
    "rule_id string, mode string, severity string, execution string, intent string, "
    "scope struct<include: array<string>, exclude: array<struct<glob: string, reason: string>>, require_files: array<string>>, "
    "patterns map<string, struct<regex: string, flags: struct<case_insensitive: boolean, multi_line: boolean, "
    "dot_matches_new_line: boolean, ignore_whitespace: boolean, crlf: boolean>>>, "
    "diagnostics map<string, struct<kind: string, message: string, help: string>>"
)


def explode_scope(rules: DataFrame) -> DataFrame:
    """(rule_id, role, ord, glob, reason): the include and exclude globs of every rule."""
    include = rules.select("rule_id", F.lit("include").alias("role"), F.posexplode("scope.include").alias("ord", "glob"))
    exclude = rules.select("rule_id", F.lit("exclude").alias("role"), F.posexplode("scope.exclude").alias("ord", "x"))
    return include.withColumn("reason", F.lit(None).cast("string")).unionByName(
        exclude.select("rule_id", "role", "ord", F.col("x.glob").alias("glob"), F.col("x.reason").alias("reason"))
    )


def explode_patterns(rules: DataFrame) -> DataFrame:
    """(rule_id, alias, regex, flags...) of every pattern."""
    rows = rules.select("rule_id", F.explode("patterns").alias("alias", "p"))
    return rows.select("rule_id", "alias", F.col("p.regex").alias("regex"), "p.flags.*")


def explode_diagnostics(rules: DataFrame) -> DataFrame:
    """(rule_id, code, kind, message, help) of every diagnostic."""
    return rules.select("rule_id", F.explode("diagnostics").alias("code", "d")).select("rule_id", "code", "d.*")


def effective_mode(rules: DataFrame, overrides: DataFrame, omitted_scope: str | None = None) -> DataFrame:
    """(rule_id, mode, problem): the rules' modes under (rule_id, mode) overrides.

    An override of no known rule is a row with the problem ``unknown_rule``, or
    ``inactive_override`` if its id is in the omitted scope; such rows have no mode.
    """
    own = rules.select("rule_id", F.col("mode").alias("_own"))
    over = overrides.select("rule_id", F.col("mode").alias("_over"))
    known = own.join(over, "rule_id", "left").select("rule_id", F.coalesce("_over", "_own").alias("mode"), F.lit(None).cast("string").alias("problem"))
    problem = F.lit("unknown_rule")
    if omitted_scope:
        problem = F.when(F.startswith("rule_id", F.lit(f"{omitted_scope}/")), "inactive_override").otherwise(problem)
    unknown = over.join(own, "rule_id", "left_anti").select("rule_id", F.lit(None).cast("string").alias("mode"), problem.alias("problem"))
    return known.unionByName(unknown)


def package_digests(files: DataFrame) -> DataFrame:
    """(rule_id, rule_digest) over a rule's (rule_id, path, content) files, ordered by path."""
    parts = F.array_sort(F.collect_list(F.struct("path", "content")))
    grouped = files.groupBy("rule_id").agg(parts.alias("files"))
    flat = F.flatten(F.transform("files", lambda f: F.array(f["path"], f["content"])))
    return grouped.select("rule_id", framed_list_digest(PACKAGE, flat).alias("rule_digest"))


def execution_digests(rules: DataFrame) -> DataFrame:
    """(rule_id, execution_digest) of what a rule's results depend on.

    Mode, severity and the wording of diagnostics are left out: editing them keeps results.
    """
    kept = F.to_json(F.struct("rule_id", "execution", "patterns", F.array_sort(F.map_keys("diagnostics")).alias("codes")))
    return rules.select("rule_id", framed_digest("execution-1", kept).alias("execution_digest"))
