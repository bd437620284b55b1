"""Rules meet files: scope as a join on paths.

Scopes are joined on the path column alone; texts are joined back by path afterwards, so
they are read only for paths in some scope.  Rules with equal scopes are matched once.
A scope whose globs name folders or suffixes meets only the paths that have them, by an
equality join.  The rule side is a dimension table: its rows and bytes are checked before
it is broadcast, and a larger one is shuffled by those keys.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.globs import any_glob_regex, lookup_keys, path_keys

#: Rows and bytes up to which a table of rules or scopes is broadcast.
BROADCAST_SCOPES, BROADCAST_BYTES = 10_000, 8 << 20
#: Scopes without a key that are conditions of one scan.
LITERAL_SCOPES = 64


def scope_patterns(rules: DataFrame) -> DataFrame:
    """(rule_id, include_re, exclude_re, require_files): one pattern each for any include and any exclude."""
    pattern = F.udf(lambda globs: any_glob_regex(globs or []) or "(?!)", "string", useArrow=True)
    return rules.select(
        "rule_id", pattern(F.col("scope.include")).alias("include_re"), pattern(F.col("scope.exclude.glob")).alias("exclude_re"),
        F.coalesce("scope.require_files", F.array().cast("array<string>")).alias("require_files"),
    )


def in_scope(path: Column, include_re: Column, exclude_re: Column) -> Column:
    """Exclusion wins."""
    return F.rlike(path, include_re) & ~F.rlike(path, exclude_re)


def _small(df: DataFrame) -> DataFrame:
    """``df``, evaluated once and to be broadcast if it is a table of few rows and bytes; else as it is."""
    head = df.limit(BROADCAST_SCOPES + 1).toArrow()
    if head.num_rows > BROADCAST_SCOPES or head.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))


def _met(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """(include_re, exclude_re, path) of every file inside each distinct scope.

    A scope is looked up by the folders or suffixes that its globs name (an equality join of
    keys), its patterns are asked only for those paths.  Scopes without such a key are asked
    for every path: up to ``LITERAL_SCOPES`` as conditions of the scan, more in blocks.
    """
    spark, paths = files.sparkSession, files.select("path")
    names = ("include_re", "exclude_re")
    inside = lambda p: (F.regexp_instr(p, F.col("include_re")) > 0) & (F.regexp_instr(p, F.col("exclude_re")) == 0)
    head = scopes.select(*names).limit(BROADCAST_SCOPES + 1).toArrow()
    parts, wide = [], None
    if head.num_rows <= BROADCAST_SCOPES and head.nbytes <= BROADCAST_BYTES:
        rows = [(i, e, k) for i, e in sorted({(r["include_re"], r["exclude_re"]) for r in head.to_pylist() if None not in r.values()}) for k in lookup_keys(i)]
        general = [(i, e) for i, e, k in rows if not k]
        keyed = [r for r in rows if r[2]]
        if keyed:
            keyed = F.broadcast(spark.createDataFrame(pa.table(dict(zip((*names, "key"), map(pa.array, zip(*keyed)))))))
        if 0 < len(general) <= LITERAL_SCOPES:
            path = F.col("path")
            own = [F.when(in_scope(path, F.lit(i), F.lit(e)), F.struct(F.lit(i).alias("include_re"), F.lit(e).alias("exclude_re"))) for i, e in general]
            parts.append(paths.select("path", F.inline(F.array_compact(F.array(*own)))).select(*names, "path"))
        elif general:
            wide = F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, zip(*general)))))))
    else:
        keys = F.udf(lookup_keys, "array<string>", useArrow=True)
        every = scopes.select(*names).where("include_re is not null and exclude_re is not null").distinct().select(*names, F.explode(keys("include_re")).alias("key"))
        keyed, wide = every.where("key != ''"), every.where("key = ''").drop("key")
    if keyed:
        parts.append(paths.select("path", F.explode(path_keys(F.col("path"))).alias("key")).join(keyed, "key").where(inside(F.col("path"))).select(*names, "path"))
    if wide is not None:
        # Blocks of at most 2048 paths, so patterns are compiled once a block and not once a path.
        row = F.monotonically_increasing_id()  # rows of one input partition are numbered without gaps
        blocks = paths.select("path", F.floor(row / 2048).alias("block")).groupBy("block").agg(F.collect_list("path").alias("paths"))
        parts.append(blocks.join(wide, F.lit(True)).select(*names, F.explode(F.filter("paths", inside)).alias("path")))
    if not parts:
        return paths.where("false").select(*[F.lit(None).cast("string").alias(n) for n in names], "path")
    return reduce(DataFrame.unionByName, parts)


def scope_join(scopes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, path) for every file in a rule's scope; a scope with a null pattern holds no file."""
    rules = _small(scopes.select("rule_id", "include_re", "exclude_re"))
    return _met(rules, corpus).join(rules, ["include_re", "exclude_re"]).select("rule_id", "path")


def require_files(scopes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, applicable): whether all files that a rule requires exist."""
    wanted = scopes.select("rule_id", F.explode("require_files").alias("path"))
    there = wanted.join(corpus.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    met = there.groupBy("rule_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("met"))
    return scopes.select("rule_id").join(met, "rule_id", "left").select("rule_id", F.coalesce("met", F.lit(True)).alias("applicable"))


def unmatched_includes(globs: DataFrame, corpus: DataFrame, applicable: DataFrame | None = None) -> DataFrame:
    """(rule_id, glob) of include globs that match no eligible file; ``globs`` has (rule_id, glob, regex)."""
    eligible = corpus.where(F.col("status").isin("checked", "unchanged_dependency")) if "status" in corpus.columns else corpus
    if applicable is not None:
        globs = globs.join(applicable.where("applicable").select("rule_id"), "rule_id", "left_semi")
    scopes = globs.select(F.col("regex").alias("include_re"), F.lit("(?!)").alias("exclude_re"))
    used = _met(scopes, eligible).select(F.col("include_re").alias("regex")).distinct()
    return globs.join(used, "regex", "left_anti").select("rule_id", "glob")


def scoped_file_counts(scopes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, n_files) with zeros."""
    counts = scope_join(scopes, corpus).groupBy("rule_id").agg(F.count("*").alias("n"))
    return scopes.select("rule_id").join(counts, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n_files"))


def relevant_gaps(gaps: DataFrame, scopes: DataFrame) -> DataFrame:
    """Gaps that some rule's scope covers."""
    return gaps.join(_met(scopes, gaps).select("path").distinct(), "path", "left_semi").select(*gaps.columns)


def explain_scope(scopes: DataFrame, classified: DataFrame, applicable: DataFrame) -> DataFrame:
    """(rule_id, path, reason): the decisive reason for every rule and path.

    ``classified`` has (path, is_ignored, status, reason): ignored, excluded by policy, a gap,
    not included, excluded by the rule, a required file missing, or in scope.
    """
    pairs = classified.crossJoin(_small(scopes.join(applicable, "rule_id")))
    reason = (
        F.when(F.col("is_ignored"), "ignored")
        .when(F.col("status") == "excluded", F.concat(F.lit("excluded: "), F.col("reason")))
        .when(F.col("status") == "gap", F.concat(F.lit("gap: "), F.col("reason")))
        .when(~F.rlike("path", "include_re"), "not_included").when(F.rlike("path", "exclude_re"), "excluded_by_rule")
        .when(~F.col("applicable"), "missing_required_file").otherwise("in_scope")
    )
    return pairs.select("rule_id", "path", reason.alias("scope_reason"))
