"""Pattern search with exact byte spans.

Matches and the gaps between them are both arrays of one text; running sums of their byte
lengths, taken by blocks inside the row, give every offset without a shuffle, and a text
with many matches costs what its matches cost, not their square.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusward.functions.regexes import compiled, java_pattern, solid_pattern
from corpusward.functions.text import java_quote


def is_match(df: DataFrame, pattern: str, text_col: str = "text", **flags: bool) -> DataFrame:
    """``df`` with ``is_match``: whether the pattern is found anywhere in the text."""
    return df.withColumn("is_match", F.col(text_col).rlike(java_pattern(pattern, **flags)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running_sums(sizes: Column, block: int = 64) -> Column:
    """Running sums of an array of longs, by blocks: a fold of the blocks, and short sums inside them."""
    zero = F.lit(0).cast("long")
    add = lambda acc, x: acc + x

    def of(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        sums = F.transform(starts, lambda b: F.aggregate(F.slice(s, b * block + 1, F.lit(block)), zero, add))
        first = F.struct(zero.alias("at"), F.array(zero).alias("all"))
        before = F.aggregate(sums, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"] + x).alias("all")))["all"]

        def total(p: Column) -> Column:
            return F.transform(s, lambda _, i: F.get(p, F.floor(i / block).cast("int")) + F.aggregate(F.slice(s, (i - i % block) + 1, i % block + 1), zero, add))

        return _let(before, total)

    return F.when(F.size(sizes) > 0, _let(sizes, of))


def find_all(df: DataFrame, pattern: str, keys: list[str] = ["path"], text_col: str = "text", groups: bool = False, **flags: bool) -> DataFrame:  # noqa: B006
    """(keys, ord, start_byte, end_byte, text[, groups]): all non-overlapping matches, leftmost first.

    ``groups`` adds the named groups of each match, null where a group took no part (and empty
    where it took part without taking a character).  Patterns
    that match the empty text, and groups of patterns with anchors or boundaries, are stepped
    through in Arrow tasks; all others stay in the JVM.
    """
    c = compiled(pattern, **flags)
    if c.empty or (groups and c.around):
        return stepped(df, F.lit(c.steps), keys, text_col, list(c.names) if groups else None)
    hits = df.where(F.col(text_col).rlike(c.java))
    found = spans(hits, F.lit(c.java), keys, text_col)
    return found.withColumn("groups", _groups(F.col("text"), c.java, c.names, False)) if groups else found


def spans(df: DataFrame, java: Column, keys: list[str], text_col: str = "text", located: bool = False) -> DataFrame:
    """(keys, ord, start_byte, end_byte, text) for a Java pattern, given by a column, that takes a character in every match.

    Offsets are running sums of the byte lengths of gaps and matches.  ``located`` adds
    LOCATED: where a match starts and ends by line and column, and the lines around it, from
    the same pass.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, java, F.lit(0))
    rows = df.select(*keys, found.alias("_m"), F.split(text, java, -1).alias("_g"), *[F.split(text, "\n", -1).alias("_l")] * located)
    sums = lambda of: running_sums(F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: (of(g) + of(m)).cast("long")))
    arrays = {"m": F.col("_m"), "e": sums(F.octet_length)}
    if located:
        breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        rows = rows.withColumns({"_n": sums(breaks), "_c": sums(F.length), "_s": running_sums(F.transform("_l", lambda x: F.length(x).cast("long") + 1))})
        arrays["at"] = F.transform(F.col("_m"), lambda m, i: _place(m, F.get("_n", i), F.get("_c", i), breaks))
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])).alias("ord", "_x"))
    end = F.col("_x.e")
    return rows.select(*keys, "ord", (end - F.octet_length("_x.m")).alias("start_byte"), end.alias("end_byte"), F.col("_x.m").alias("text"), *["_x.at.*"] * located)


LOCATED = ["start_line", "start_column", "end_line", "end_column", "snippet"]


def _place(m: Column, breaks_upto: Column, chars_upto: Column, breaks) -> Column:
    """LOCATED of a match, from line breaks and characters up to its end, the line ends ``_s`` and the lines ``_l``."""
    first, last = (breaks_upto - breaks(m) + 1).cast("int"), (breaks_upto + 1).cast("int")
    column = lambda chars, line: chars - F.when(line > 1, F.get("_s", line - 2)).otherwise(F.lit(0).cast("long")) + 1
    start_column = column(chars_upto - F.length(m), first)
    snippet = F.struct(
        F.when(first > 1, F.get("_l", first - 2)).alias("before"), F.get("_l", first - 1).alias("line"), F.get("_l", first).alias("after"),
        (start_column + F.length(F.substring_index(m, "\n", 1))).cast("long").alias("caret_end_column"), (last - first).cast("long").alias("extra_lines"),
    )
    return F.struct(first.cast("long").alias("start_line"), start_column.alias("start_column"), last.cast("long").alias("end_line"), column(chars_upto, last).alias("end_column"), snippet.alias("snippet"))


def group_of(text: Column, java: Column, number: int, anywhere: bool = False) -> Column:
    """A group of the first match of ``text`` (or of the match that is ``text``): null if it took no part.

    A group that gives the empty text took part if a reference to it after the match holds.
    The match is held fast by an atomic group, so the reference cannot bring about another one.
    """
    value = F.regexp_extract(text, java, number) if isinstance(java, str) else F.call_function("regexp_extract", text, java, F.lit(number))
    held = F.concat(F.lit("\\A(?>(?s:.*?)(?:" if anywhere else "\\A(?>(?:"), F.lit(java) if isinstance(java, str) else java, F.lit(f"))\\{number}"))
    return F.when((value != "") | F.rlike(text, held), value)


def _groups(text: Column, java: str, names: tuple[tuple[str, int], ...], anywhere: bool) -> Column:
    """The named groups of the first match: null for one that took no part, empty for one that took nothing."""
    values = [x for name, number in names for x in (F.lit(name), group_of(text, java, number, anywhere))]
    return F.create_map(*values) if values else F.create_map().cast("map<string,string>")


#: Rows that a stepping task gathers before it hands them on.
STEPPED_ROWS = 1 << 16


def stepped(df: DataFrame, pattern: Column, keys: list[str], text_col: str = "text", groups: list[tuple[str, int]] | None = None, first: bool = False) -> DataFrame:
    """The rows of :func:`spans` for a stepping pattern given by a column, which may match the empty text.

    ``groups`` adds a map of groups, given by names and numbers; null where a group took no part or is not there.
    ``first`` looks for the first match of each text only.  Matches are handed on in batches of
    ``STEPPED_ROWS``, in the middle of a text too, so memory grows with the longest text and not with its matches.
    """
    schema = df.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = f"{kinds}, ord int, start_byte long, end_byte long, text string" + (", groups map<string,string>" if groups is not None else "")

    work = lambda batches: _stepping(batches, keys, groups, first)
    return df.select(*keys, text_col, pattern.alias("_pattern")).mapInArrow(work, out)


def _stepping(batches: Iterator[pa.RecordBatch], keys: list[str], groups: list[tuple[str, int]] | None, first: bool) -> Iterator[pa.RecordBatch]:
    """The matches of batches of (keys, text, pattern)."""
    finds: dict[str, regex.Pattern] = {}
    find_of = lambda p: finds.get(p) or finds.setdefault(p, regex.compile(p))
    for batch in batches:
        held: list[tuple] = []  # (row, first number, starts, ends, texts, groups)
        n = 0
        for i, (t, p) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1))):
            if (t := t.as_py()) is None:
                continue
            find, solid = find_of(p := p.as_py()), solid_pattern(p) if groups is None and not first else None
            for part in _filled(find_of(solid), t) if solid else _found(find, t, groups, first):
                held.append((i, *part))
                n += len(part[1])
                if n >= STEPPED_ROWS:
                    yield _stepped_rows(batch, keys, held, groups)
                    held, n = [], 0
        if held:
            yield _stepped_rows(batch, keys, held, groups)


def _found(find: regex.Pattern, t: str, groups: list[tuple[str, int]] | None, first: bool) -> Iterator[tuple]:
    """(first number, starts, ends, texts, groups) of the matches of one text, so many at a time."""
    n, last, at, at_byte = 0, -1, 0, 0
    start, end, text, named = [], [], [], []
    for m in filter(None, [find.search(t)]) if first else find.finditer(t):
        if m.start() == m.end() == last:
            continue  # no empty match next to the previous match
        last = m.end()
        at_byte += len(t[at : m.start()].encode())
        start.append(at_byte)
        at_byte += len(m[0].encode())
        at = m.end()
        end.append(at_byte), text.append(m[0]), named.append([(name, m[k] if k <= find.groups else None) for name, k in groups or ()])
        if len(start) == STEPPED_ROWS:
            yield n, np.array(start), np.array(end), pa.array(text, pa.string()), named
            n += len(start)
            start, end, text, named = [], [], [], []
    if start:
        yield n, np.array(start), np.array(end), pa.array(text, pa.string()), named


def _filled(solid: regex.Pattern, t: str) -> Iterator[tuple]:
    """The same for a pattern that stops at every place of a text, given what takes a character there."""
    data = t.encode()
    stops = np.ones(len(data) + 1, bool)
    stops[:-1] = np.frombuffer(data, np.uint8) & 0xC0 != 0x80  # where characters begin, and the end
    starts, ends = array("q"), array("q")
    at = at_byte = 0
    for m in solid.finditer(t):
        start = at_byte + len(t[at : m.start()].encode())
        at, at_byte = m.end(), start + len(m[0].encode())
        stops[start + 1 : at_byte + 1] = False
        stops[start] = True
        starts.append(start), ends.append(at_byte)
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    n = 0
    for low in range(0, len(stops), STEPPED_ROWS):
        start = np.flatnonzero(stops[low : low + STEPPED_ROWS]) + low
        end = start.copy()
        own = slice(*np.searchsorted(starts, [low, low + STEPPED_ROWS]))
        end[np.searchsorted(start, starts[own])] = ends[own]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        text = pa.py_buffer(b"".join([data[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]))
        yield n, start, end, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), text), ()
        n += len(start)


def _stepped_rows(batch: pa.RecordBatch, keys: list[str], held: list[tuple], groups: list[tuple[str, int]] | None) -> pa.RecordBatch:
    rows, first, starts, ends, texts, named = zip(*held)
    sizes = list(map(len, starts))
    at = pa.array(np.repeat(rows, sizes))
    number = np.concatenate([np.arange(n, n + size, dtype=np.int32) for n, size in zip(first, sizes)])
    text = pa.concat_arrays([x.cast(pa.string()) for x in texts])
    arrays = [*[batch.column(k).take(at) for k in range(len(keys))], pa.array(number), pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(ends), pa.int64()), text]
    if groups is not None:
        arrays.append(pa.array([g for x in named for g in x], pa.map_(pa.string(), pa.string())))
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "ord", "start_byte", "end_byte", "text"] + ["groups"] * (groups is not None))


def find_in(regions: DataFrame, pattern: str, keys: list[str], **flags: bool) -> DataFrame:
    """Matches inside each region (keys, start_byte, text) as a text of its own, in absolute bytes."""
    inner = find_all(regions.select(*keys, F.col("start_byte").alias("_base"), "text"), pattern, [*keys, "_base"], **flags)
    return inner.select(*keys, "ord", (F.col("start_byte") + F.col("_base")).alias("start_byte"), (F.col("end_byte") + F.col("_base")).alias("end_byte"), "text")


def capture_text(df: DataFrame, pattern: str, text_col: str = "text", **flags: bool) -> DataFrame:
    """``df`` with ``captured``, the first match, and ``groups``; both null where there is none, a group that took no part too."""
    c = compiled(pattern, **flags)
    hit = F.col(text_col).rlike(c.java)
    return df.withColumns({
        "captured": F.when(hit, F.regexp_extract(F.col(text_col), c.java, 0)),
        "groups": F.when(hit, _groups(F.col(text_col), c.java, c.names, True)),
    })


def literal_presence(df: DataFrame, literals: list[str], keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(keys, literal, present): every literal against every text, in one scan; overlaps all count."""
    tests = F.array(*[F.struct(F.lit(x).alias("literal"), F.contains(F.col(text_col), F.lit(x)).alias("present")) for x in literals])
    return df.select(*keys, F.inline(tests))


#: Literals, and their bytes, that one pass looks for.
LITERALS, LITERAL_BYTES = 100_000, 8 << 20


def literal_hits(df: DataFrame, literals: DataFrame, keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(keys, literal) for every distinct ``literal`` that a text holds, overlapping or not.

    A text is read once for all literals by an automaton of them, so time does not grow with
    their number.  Automata hold about ``LITERALS`` literals or ``LITERAL_BYTES`` bytes; a larger
    table takes several passes, none holding more.  The empty literal is in every text;
    null literals and texts are in none.
    """
    words = literals.select("literal").where("literal is not null").distinct()
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("literal")), F.lit(0))).first()
    passes = max(1, -(-n // LITERALS), -(-size // LITERAL_BYTES))
    texts = df.select(*keys, F.col(text_col).alias("_text")).where("_text is not null")
    schema = StructType([*df.select(*keys).schema.fields, StructField("literal", StringType())])

    def finder(own: list[str]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, word in enumerate(own):
                if word:
                    automaton.add_word(word, k)
            automaton.make_automaton()
            always = {k for k, word in enumerate(own) if not word}

            def rows(batch: pa.RecordBatch, at: list[int], hits: list[int]) -> pa.RecordBatch:
                kept = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array([own[k] for k in hits], pa.string())], names=schema.names)

            for batch in batches:
                at: list[int] = []
                hits: list[int] = []
                for i, text in enumerate(batch.column(len(keys))):
                    found = always | ({k for _, k in automaton.iter(text.as_py())} if len(automaton) else set())
                    at += [i] * len(found)
                    hits += sorted(found)
                    if len(hits) > 1 << 16:
                        yield rows(batch, at, hits)
                        at, hits = [], []
                yield rows(batch, at, hits)

        return work

    parts = []
    for k in range(passes):
        own = words.where(F.pmod(F.xxhash64("literal"), F.lit(passes)) == k).toArrow()["literal"].to_pylist()
        parts.append(texts.mapInArrow(finder(sorted(own)), schema))
    return reduce(DataFrame.unionByName, parts)


def first_match(df: DataFrame, pattern: str, keys: list[str] = ["path"], text_col: str = "text", **flags: bool) -> DataFrame:  # noqa: B006
    """(keys, start_byte, end_byte, text) of the first match of each text that has one."""
    c = compiled(pattern, **flags)
    if c.empty:
        return stepped(df, F.lit(c.steps), keys, text_col, first=True).drop("ord")
    java, text = c.java, F.col(text_col)
    hits = df.where(text.rlike(java))
    before = F.split(text, F.lit(java), 2)[0]
    start = F.octet_length(before).cast("long")
    found = F.regexp_extract(text, java, 0)
    return hits.select(*keys, start.alias("start_byte"), (start + F.octet_length(found)).alias("end_byte"), found.alias("text"))


def lines(df: DataFrame, keys: list[str] = ["path"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(keys, line_no, start_byte, end_byte, text): split at LF, one CR before it dropped.

    There is no extra line after a final LF; a last line without LF keeps its CR.
    """
    rows = df.select(*keys, F.split(F.col(text_col), "\n", -1).alias("_p"))
    ends = running_sums(F.transform("_p", lambda p: F.octet_length(p).cast("long") + 1))
    rows = rows.select(*keys, F.size("_p").alias("_n"), F.posexplode(F.arrays_zip(F.col("_p").alias("p"), ends.alias("e"))).alias("_i", "_x"))
    last, raw = F.col("_i") == F.col("_n") - 1, F.col("_x.p")
    rows = rows.where(~last | (raw != ""))
    start = F.col("_x.e") - F.octet_length(raw) - 1
    inner = F.when(last, raw).otherwise(F.regexp_replace(raw, "\r\\z", ""))
    rows = rows.select(*keys, (F.col("_i") + 1).cast("long").alias("line_no"), start.alias("start_byte"), inner.alias("text"))
    return rows.select(*keys, "line_no", "start_byte", (F.col("start_byte") + F.octet_length("text")).alias("end_byte"), "text")


__all__ = ["capture_text", "find_all", "find_in", "first_match", "is_match", "java_quote", "lines", "literal_hits", "literal_presence", "spans", "stepped"]
