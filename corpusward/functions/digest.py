"""Content digests and framed compound digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The domain of each compound digest.
FINDING = "WT-FINDING-1"
EVIDENCE = "WT-REVIEW-EVIDENCE-1"
CONTEXT = "WT-REVIEW-CONTEXT-1"
RECORD = "WT-REVIEW-RECORD-1"
PACKAGE = "WT-PACKAGE-1"
RESULT = "WT-RAW-FILE-3"
#: Domain of a cross-file rule's result; its form is this library's own.
REPOSITORY_RESULT = "repository-result-1"


def text_digest(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 bytes; null for null."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def framed(part: Column) -> Column:
    """The bytes of ``part`` after their number as an unsigned 64-bit big-endian value."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(part).cast("long")), 16, "0"))
    return F.concat(size, part.cast("binary"))


def framed_digest(domain: str, *parts: Column) -> Column:
    """Digest of a domain and parts, each framed, so that no two part lists share their bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(framed(F.lit(domain)), *map(framed, parts)), 256))


def framed_list_digest(domain: str, parts: Column) -> Column:
    """The same over an array of texts, in the array's order."""
    body = F.aggregate(parts, framed(F.lit(domain)), lambda done, part: F.concat(done, framed(part)))
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def json_array(*items: Column) -> Column:
    """The compact JSON array of texts and whole numbers; texts are escaped, numbers stay bare."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def json_text(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def with_digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``file_digest`` and ``n_bytes`` of its text."""
    text = F.col(text_col)
    return df.withColumns({"file_digest": text_digest(text), "n_bytes": F.octet_length(text).cast("long")})
