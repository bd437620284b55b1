"""Structured records as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_records(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``record`` and ``reason``: text that does not parse is a gap with ``parse_error``."""
    value = F.try_parse_json(F.col(text_col))
    return df.withColumn("record", value).withColumn("reason", F.when(F.col("record").isNull() & F.col(text_col).isNotNull(), "parse_error"))


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def get(value: Column, *keys: str, as_type: str = "variant") -> Column:
    """The direct child under each key in turn; null if it is no object or has no such key."""
    for key in keys[:-1]:
        value = F.try_variant_get(value, _path(key), "variant")
    return F.try_variant_get(value, _path(keys[-1]), as_type)


def entries(df: DataFrame, column: str) -> DataFrame:
    """``df`` with (key, value) of each object entry; rows that hold no object give none."""
    held = df.where(kind(F.col(column)) == "object")
    exploded = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col(column).outer()))
    return exploded.select(*df.columns, "key", "value")


def items(df: DataFrame, column: str) -> DataFrame:
    """``df`` with (pos, value) of each array item; rows that hold no array give none."""
    held = df.where(kind(F.col(column)) == "array")
    exploded = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col(column).outer()))
    return exploded.select(*df.columns, "pos", "value")


def kind(value: Column) -> Column:
    """object, array, string, integer, float, boolean or null."""
    shape = F.schema_of_variant(value)
    return (
        F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").when(shape == "STRING", "string")
        .when(shape == "BIGINT", "integer").when(shape.isin("DOUBLE", "FLOAT") | F.startswith(shape, F.lit("DECIMAL")), "float")
        .when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
    )


def text_of(value: Column) -> Column:
    """Decoded text of a string, the JSON form of anything else."""
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def allowlist_entries(df: DataFrame, column: str, section: str, allowed: DataFrame, alias_key: str | None = None) -> DataFrame:
    """Entries of a section whose resolved name is not among ``allowed`` (name).

    An entry's name is its key, or the text under ``alias_key`` in its value.
    """
    part = entries(df.withColumn("_section", get(F.col(column), section)), "_section")
    name = F.col("key")
    if alias_key:
        name = F.coalesce(F.try_variant_get("value", _path(alias_key), "string"), name)
    return part.withColumn("name", name).join(allowed.select("name").distinct(), "name", "left_anti").drop("_section")
