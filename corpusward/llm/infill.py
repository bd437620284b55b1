"""Fill-in-middle texts by one match of a pattern that counts lines.

A text of n lines is cut after two random numbers of lines.  The pattern is made for each
row: ``((?:line){a}+)((?:line){b-a}+)(.*)``.  The counts are exact and possessive, so the
match steps over lines without a stack and never goes back; one replacement puts prefix,
middle and suffix into their places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or a last line without one.
UNIT = r"[^\n]*+\n|[^\n]++"
MARKS = ("<P>", "<S>", "<M>")


def _number(id_col: Column, seed: int, k: int) -> Column:
    """The k-th eight hexadecimal digits of the row's hash as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must be found again wherever they stand: none holds another, none begins with what one ends with."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {marks} overlap")


def _quoted(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def infill(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """(id_col, n, form, output, prefix_chars, middle_chars) of every row.

    ``marks`` stand before prefix, suffix and middle.  ``percent`` of the rows are rearranged,
    ``spm_percent`` of these with the suffix first; which ones, and where a text is cut, depends
    on ``seed`` and the id alone, so reruns agree and rows of one id are cut by the same numbers.
    Null and empty texts and texts that hold a mark stay ``plain``: the output is the text (null:
    empty), the lengths are null.  Null ids count as empty ones.  Texts of any length and number
    of lines take one pass each.  Repeated rows give repeated rows; an empty table gives none.
    """
    _checked(marks)
    p, s, m = marks
    key = F.col(id_col)
    rows = docs.select(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *[_number(key, seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    rows = rows.withColumn("n", F.regexp_count("t", F.lit(UNIT)).cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("t") == "") | (F.col("h3") % 100 >= percent)
    for mark in marks:
        plain = plain | F.contains("t", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("id", "t", "n", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), form.alias("form"))
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z".replace("%d", "\0").replace("%", "%%").replace("\0", "%d"), F.col("a"), F.col("b") - F.col("a"))
    p_, s_, m_ = map(_quoted, marks)
    order = F.when(F.col("form") == "psm", f"{p_}$1{s_}$3{m_}$2").otherwise(f"{s_}$3{p_}$1{m_}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("t")).otherwise(F.regexp_replace("t", pattern, order)))
    at = lambda mark: F.locate(mark, F.col("output"))
    prefix = F.when(F.col("form") == "psm", at(s) - 1 - len(p)).when(F.col("form") == "spm", at(m) - at(p) - len(p))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at(m) + 1 - len(m))
    return rows.select(F.col("id").alias(id_col), "n", "form", "output", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form."""
    p, s, m = (re.escape(x) for x in marks)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*){s}(.*){m}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*){p}(.*){m}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`infill` with the digests of outputs and restored texts in place of the outputs."""
    made = infill(docs, id_col, text_col)
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
