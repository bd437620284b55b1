"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives the loss of any executor.  Tables go
below ``spark.checkpoint.dir``; only where a session has no such setting (tests,
a laptop) a local folder is chosen and set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        found = _local[0]
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, read with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusward/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
