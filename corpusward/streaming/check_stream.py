"""Checks of arriving document versions as a streaming query.

Detection is stateless.  Each micro-batch is checked incrementally against the stored
results, so a version that arrives again adds nothing.  The results of a micro-batch become
visible together; one that is run again after a failure is written anew if it was not complete
and is left alone if it was.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.plans.incremental import append_store, check_incremental, read_store


def check_stream(rules: DataFrame, stream: DataFrame, store_path: str, checkpoint: str, event_time: str | None = None, delay: str = "1 hour"):
    """Start a query that appends the results of arriving (path, text) rows to the store at ``store_path``.

    It takes what is there and stops (available now).  With ``event_time``, rows that repeat a
    path and content within ``delay`` are dropped before they reach a batch.
    """
    source = stream.withColumn("_digest", F.sha2("text", 256))
    if event_time:
        source = source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["path", "_digest"])

    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        files = batch.select("path", "text").dropDuplicates(["path", "text"])
        _, fresh, _ = check_incremental(rules, files, read_store(batch.sparkSession, store_path))
        append_store(fresh, store_path, f"{stream_name}-{number}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
