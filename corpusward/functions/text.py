"""Text operators of detectors, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java class.
WHITE = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def contains(text: Column, needle: Column) -> Column:
    """Case sensitive; the empty needle is in every text."""
    return F.contains(text, needle)


def starts_with(text: Column, start: Column) -> Column:
    return F.startswith(text, start)


def ends_with(text: Column, end: Column) -> Column:
    return F.endswith(text, end)


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+\\z", "")


def split_literal(text: Column, separator: str) -> Column:
    """Fields between separators, empty ones too; the empty separator is an error."""
    if not separator:
        raise ValueError("the separator must not be empty")
    return F.split(text, java_quote(separator), -1)


def replace(text: Column, old: str, new: str) -> Column:
    """All non-overlapping places, from the left; an empty ``old`` is an error."""
    if not old:
        raise ValueError("the text to replace must not be empty")
    return F.replace(text, F.lit(old), F.lit(new))


def len_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def same(a: Column, b: Column) -> Column:
    """Equality in which absent equals absent."""
    return a.eqNullSafe(b)


def checked(op: str, a: Column, b: Column, on_error: str = "raise") -> Column:
    """Whole-number arithmetic; overflow and division by zero raise, or give null with ``on_error="null"``.

    Division and remainder truncate toward zero.
    """
    if on_error == "null":
        tries = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
        if op in tries:
            return tries[op](a.cast("long"), b.cast("long"))
        safe = F.when(b != 0, b.cast("long"))
        return _truncated(op, a.cast("long"), safe)
    a, b = a.cast("long"), b.cast("long")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}.get(op, lambda: _truncated(op, a, b))()


def _truncated(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return ((a - a % b).cast("decimal(38,0)") / b).cast("long")
    if op == "%":
        return a % b
    raise ValueError(f"unknown operation {op!r}")


def java_quote(literal: str) -> str:
    """A Java pattern that matches the literal."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)
