"""Path globs as anchored Java patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A pattern that matches a whole path as the glob does.

    ``*`` and ``?`` stay inside one component, ``**`` spans whole components, ``[..]`` is a
    class (``!`` or ``^`` negates), ``{a,b}`` are alternatives; case matters.
    """
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and glob[i - 1 : i] in ("", "/") and glob[i + 2 : i + 3] in ("", "/"):
            if glob[i + 2 : i + 3] == "/":
                out, i = out + "(?:[^/]+/)*", i + 3
            else:
                out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")) - 1)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^/' if negated else ''}{body}]" if negated else f"(?!/)[{body}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {glob!r}")
    return f"(?s)^(?:{out})\\z"


def glob_match(path: Column, glob: str) -> Column:
    """Whether a path matches a glob."""
    return path.rlike(glob_regex(glob))


def any_glob_regex(globs: list[str]) -> str | None:
    """One pattern for any of several globs; None if there are none."""
    return "|".join(f"(?:{glob_regex(g)})" for g in globs) or None


_ALTERNATIVE = re.compile(r"\(\?s\)\^\(\?:(?P<body>.*)\)\\z", re.S)
_HEAD = re.compile(r"((?:[^\\.\[\](){}*+?|^$]|\\[^A-Za-z0-9])*)([*+?{]?)", re.S)
_SUFFIX = re.compile(r"\\(\.[A-Za-z0-9_]+)\Z")


def lookup_keys(pattern: str) -> list[str]:
    """Keys of :func:`path_keys`, exactly one of which every path has that a pattern of globs matches.

    They are the literal folders that its globs begin with, if all do, or else the suffixes
    that they end in, if all do.  Other patterns have the one empty key, for every path.
    """
    wrapped = pattern.startswith("(?:(?s)") and pattern.endswith(")")
    found = [_ALTERNATIVE.fullmatch(a) for a in (re.split(r"\)\|\(\?:(?=\(\?s\)\^)", pattern[3:-1]) if wrapped else [pattern])]
    if not all(found):
        return [""]
    folders, suffixes = set(), set()
    for m in found:
        literal, repeated = _HEAD.match(m["body"]).groups()
        if repeated:  # the last character belongs to what follows
            literal = re.sub(r"\\?.\Z", "", literal, flags=re.S)
        folders.add(re.sub(r"\\(.)", r"\1", literal[: literal.rfind("/") + 1], flags=re.S))
        suffix = _SUFFIX.search(m["body"])
        suffixes.add(suffix[1] if suffix else "")
    if "" not in folders:
        return sorted(f for f in folders if not any(f != g and f.startswith(g) for g in folders))
    return [""] if "" in suffixes else sorted(suffixes)


def path_keys(path: Column) -> Column:
    """The folders around a path, each with its slash, and its suffix: what :func:`lookup_keys` names."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return F.concat(F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>")), F.array(F.regexp_extract(path, r"\.[A-Za-z0-9_]+\z", 0)))
