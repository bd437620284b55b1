"""Tables that a plan writes once and reads several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusward.streaming.paths import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again with its own schema."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
