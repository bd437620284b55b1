"""Incremental checks: only rule-file pairs whose content-keyed result is not stored run.

The store holds a key row for every evaluated pair, findings or not, and of each finding what
the scan told of it, so an unchanged pair costs one join row and no text.  It is a folder of
batches; a batch is there when its writer has marked it as complete, and not before.  Each is
partitioned by buckets of paths, and a run reads the buckets of its own paths only.

Pairs that miss share evaluations: what runs is each distinct pattern on each distinct file
that some missing pair wants it for, and its matches fan out to the rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.digest import CONTEXT, framed_digest, text_digest, with_digest
from corpusward.operators.detect import compile_rules
from corpusward.operators.findings import add_coordinates, add_snippet, result_key
from corpusward.operators.patterns import LOCATED, spans, stepped
from corpusward.operators.scope import _small, in_scope

from .written import written

#: What a stored finding holds beside its rule, path, code and span.
EVIDENCE = (
    "file_digest string, matched_digest string, start_line long, start_column long, end_line long, end_column long, "
    "snippet struct<before: string, line: string, after: string, caret_end_column: long, extra_lines: long>"
)
#: A stored row: a pair's key and, if it has findings, one of them.
STORE = f"result_key string, rule_id string, path string, code string, start_byte long, end_byte long, n_bytes long, {EVIDENCE}, bucket int"
#: Buckets of paths by which a store is partitioned.
BUCKETS = 64
_EVIDENCE = ["file_digest", "matched_digest", *LOCATED]
FINDING = ["rule_id", "path", "code", "start_byte", "end_byte", *_EVIDENCE]


def keyed_pairs(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """(result_key, rule_id, path, file_digest, n_bytes) of every rule and file in its scope; no text is kept."""
    small = rules.select("rule_id", "include_re", "exclude_re", "execution_digest").distinct()
    files = with_digest(corpus).select("path", "file_digest", "n_bytes")
    pairs = files.join(_small(small), in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re")))
    return pairs.select(result_key().alias("result_key"), "rule_id", "path", "file_digest", "n_bytes")


def bucket_of(path: Column) -> Column:
    return F.pmod(F.crc32(path), F.lit(BUCKETS)).cast("int")


def touched(store: DataFrame, corpus: DataFrame) -> DataFrame:
    """The rows of the store in the buckets of the corpus's paths; partitions of other buckets are not read."""
    found = sorted(b for (b,) in corpus.select(bucket_of(F.col("path"))).distinct().collect() if b is not None)  # BUCKETS rows at most
    return store if len(found) == BUCKETS else store.where(F.col("bucket").isin(found))


def spoiled_keys(store: DataFrame, rules: DataFrame) -> DataFrame:
    """(result_key) of stored results of which a finding has an unknown code or a span outside its file."""
    known = rules.select("rule_id", "code", F.lit(True).alias("_known")).distinct()
    rows = store.where("code is not null").join(_small(known), ["rule_id", "code"], "left")
    outside = (F.col("start_byte") < 0) | (F.col("start_byte") > F.col("end_byte")) | (F.col("end_byte") > F.col("n_bytes"))
    return rows.where(F.col("_known").isNull() | outside).select("result_key").distinct()


_RULE = ["rule_id", "code", "java", "steps", "empty", "needs", "include_re", "exclude_re", "execution_digest"]


def _compiled(rules: DataFrame) -> DataFrame:
    return _small(compile_rules(rules).where("problem is null").select(*_RULE))


def _hits(rows: DataFrame, corpus: DataFrame, store: DataFrame) -> DataFrame:
    """:func:`keyed_pairs` with ``_hit``: whether a sound result is stored.

    The store's keys are met by the run's, so a run over few files shuffles neither.
    """
    pairs = keyed_pairs(rows, corpus)
    have = store.select("result_key").join(pairs.select("result_key").distinct(), "result_key", "left_semi").join(spoiled_keys(store, rows), "result_key", "left_anti")
    pairs = pairs.join(have.distinct().withColumn("_hit", F.lit(True)), "result_key", "left")
    return pairs.withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _searches(missing: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, file_digest, searches): the distinct patterns that the missing pairs of each file want."""
    wants = missing.join(rows.select("rule_id", "java", "steps", "empty", "needs").distinct(), "rule_id")
    return wants.groupBy("path", "file_digest").agg(F.collect_set(F.struct("java", "steps", "empty", "needs")).alias("searches"))


def searches(rules: DataFrame, corpus: DataFrame, store: DataFrame) -> DataFrame:
    """(path, file_digest, java): the searches that :func:`check_incremental` runs, one for each pattern and file that miss."""
    rows = _compiled(rules)
    missing = _hits(rows, corpus, touched(store, corpus)).where("not _hit")
    return _searches(missing, rows).select("path", "file_digest", F.explode("searches.java").alias("java"))


def _evaluated(todo: DataFrame, empty: bool) -> DataFrame:
    """(path, file_digest, java, start_byte, end_byte, matched_digest, LOCATED): matches in (path, file_digest, text, pattern) rows."""
    keys = ["path", "file_digest", "java"]
    found = spans(todo.where(~F.col("empty") & F.contains("text", "needs") & F.rlike("text", "java")), F.col("java"), keys, located=True)
    if empty:
        by_text = todo.where("empty and text is not null").withColumn("_path", F.col("path")).withColumn("path", F.col("file_digest"))  # a path may have several texts
        some = stepped(by_text, F.col("steps"), ["path", "_path", "java"]).withColumnRenamed("text", "_match")
        files = by_text.select("path", "text").distinct()
        some = add_snippet(add_coordinates(some, files), files).withColumnRenamed("_match", "text").withColumn("file_digest", F.col("path")).withColumn("path", F.col("_path"))
        found = found.unionByName(some.select(*found.columns))
    return found.withColumn("matched_digest", text_digest(F.col("text"))).select(*keys, "start_byte", "end_byte", "matched_digest", *LOCATED)


def check_incremental(rules: DataFrame, corpus: DataFrame, store: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, new store rows, counts): stored results are reused, the rest evaluated.

    ``rules`` has (rule_id, code, regex[, flags], include_re, exclude_re, execution_digest).
    Findings have FINDING.  Counts are (rule_id, hits, misses).  Pairs in ``failed``
    (rule_id, path) are never stored.  Which pairs are stored, and what the others give, is
    written once; all three tables read that.  A path may have several versions.

    Where nothing is stored for any pair, patterns meet texts in the scan and no text is
    shuffled; otherwise the texts of the files that miss are joined once, whatever the
    number of rules and patterns.
    """
    rows = _compiled(rules)
    store = touched(store, corpus)
    pairs = written(_hits(rows, corpus, store), "pairs")
    missing = pairs.where("not _hit").drop("_hit")
    texts = corpus.select("path", "text")
    if pairs.where("_hit").isEmpty():
        shapes = rows.groupBy("java", "steps", "empty", "needs").agg(F.collect_set(F.struct("include_re", "exclude_re")).alias("scopes"))
        wants = F.exists("scopes", lambda s: in_scope(F.col("path"), s["include_re"], s["exclude_re"]))
        some = F.col("text").isNotNull() & (F.col("empty") | (F.contains("text", "needs") & F.rlike("text", "java")))
        todo = texts.join(_small(shapes), wants & some).withColumn("file_digest", text_digest(F.col("text")))
    else:
        wanted = _searches(missing, rows)
        texts = texts.join(wanted.select("path").distinct(), "path", "left_semi").withColumn("file_digest", text_digest(F.col("text"))).distinct()
        todo = texts.join(wanted, ["path", "file_digest"]).select("path", "file_digest", "text", F.inline("searches"))
    found = _evaluated(todo, not rows.where("empty").isEmpty())
    fanned = found.join(rows.select("rule_id", "code", "java", "include_re", "exclude_re").distinct(), "java").where(in_scope(F.col("path"), F.col("include_re"), F.col("exclude_re")))
    fanned = fanned.drop("java", "include_re", "exclude_re")
    fresh = missing.join(fanned, ["rule_id", "path", "file_digest"], "left").withColumn("bucket", bucket_of(F.col("path")))
    # A pair without findings has its key alone.
    digest = F.when(F.col("code").isNotNull(), F.col("file_digest")).alias("file_digest")
    fresh = fresh.select("result_key", "rule_id", "path", "code", "start_byte", "end_byte", "n_bytes", digest, *_EVIDENCE[1:], "bucket")
    if failed is not None:
        fresh = fresh.join(failed.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_anti").select(*fresh.columns)
    fresh = written(fresh, "fresh")
    used = store.where("code is not null").join(pairs.where("_hit").select("result_key").distinct(), "result_key", "left_semi")
    findings = used.select(*FINDING).unionByName(fresh.where("code is not null").select(*FINDING))
    counts = pairs.groupBy("rule_id").agg(F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("misses"))
    return findings, fresh, counts


def with_context(findings: DataFrame) -> DataFrame:
    """Findings of file rules with their context digest."""
    return findings.withColumn("context_digest", framed_digest(CONTEXT, F.col("path"), F.col("file_digest")))


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete batches of a store."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-*/_SUCCESS")
    marks = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(m.getPath().getParent().toString() for m in marks or [])


def append_store(fresh: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch to the store, whole or not at all.

    A batch under a name that is complete is left as it is; an incomplete one is written anew.
    Rows of one bucket are written by one task, so a batch has a file for each bucket it touches.
    """
    name = f"batch-{batch or uuid.uuid4().hex}"
    if batch is None or not any(b.endswith(f"/{name}") for b in _batches(fresh.sparkSession, path)):
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store at ``path``; empty if nothing has been stored."""
    folders = _batches(spark, path)
    return spark.read.schema(STORE).parquet(*folders) if folders else spark.createDataFrame([], STORE)


def compact_store(spark: SparkSession, path: str, to: str) -> None:
    """The rows of the store at ``path`` as one batch of a new store, with one file a bucket."""
    append_store(read_store(spark, path), to)
