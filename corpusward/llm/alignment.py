"""Groups of tokens of two vocabularies that cover the same bytes, by a monoid of fragments.

A is a byte-level vocabulary, B one of pieces with byte fallback.  A text's bytes are cut
where a token of A and a token of B both end; such a group holds the tokens that tell the
same bytes.

A *fragment* stands for a range of a text: either open text, in which no place is known
where both vocabularies must end a token, or an open prefix, closed groups and an open
suffix.  Two neighbours compose by closing what lies between them: the left suffix and the
right prefix.  Composition is associative, so the ranges of a very long text are turned into
fragments by many tasks and composed as a tree, whatever the ranges are.

Known places are the stable boundaries before blanks and line ends.  A's pieces end there
(white space can only begin them); B's, because no entry of B holds a blank mark after
another character, or a line end: both are looked up when the vocabulary is loaded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import TOKENIZERS, _byte_model
from .long_texts import LONGEST_REMEMBERED, REMEMBERED, batched, cut, is_long, spread, unit_pattern
from .tables import stored

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Fragments composed by one task at a time.
FAN_IN = 16
#: Rows of id pairs that are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
_UNITS = unit_pattern(r" \n")
_BLANK = "▁"
#: Units of characters whose classes every library knows alike, that end in no white space.
_PLAIN = re.compile(r"[\t\n\r -~\u00a0-\u024f]*(?<!\s)").fullmatch
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Aligner:
    """Aligned tokens of units, remembered by a task.

    Unit k has the figures ``figures[k]``, the text of its groups ``shown[k]`` and the id pairs
    of its links ``pairs[starts[k]:starts[k + 1]]``.
    """

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(str(Path(folder) / BYTE_VOCABULARY))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.plain = _byte_model(folder)
        self.b = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / PIECE_VOCABULARY))
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of.get(c, 0x20) for c in token)
        pieces = [self.b.IdToPiece(k) for k in range(self.b.GetPieceSize())]
        if any("\n" in p or _BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("an entry of the vocabulary lies across blanks or line ends")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.PieceToId(_BLANK)
        self.base = len(pieces)
        if len(self.a_bytes) * self.base >= 1 << 31:
            raise ValueError("id pairs do not fit 32 bits")
        numbers = [str(k).encode() for k in range(max(len(self.a_bytes), self.base))]
        self.digits = np.array(numbers, "S5").view(np.uint8).reshape(-1, 5)
        self.n_digits = np.array(list(map(len, numbers)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.passing: list[str] = []  # known until the next call
        self.figures = np.zeros((0, 4), np.int64)
        self.same = np.zeros(0, bool)
        self.shown: list[str] = []
        self.held = 0  # characters shown
        self.pairs = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _of_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's tokens of all units, and how many each has.

        Plain units are encoded as one text by the same vocabulary's ranks, which is much faster: a
        unit that ends in no white space begins and ends its pieces, whatever stands around it.
        """
        plain = [k for k, u in enumerate(units) if _PLAIN(u)]
        rest = sorted({*range(len(units))}.difference(plain))
        joined = np.array(self.plain.encode_ordinary("".join([units[k] for k in plain])), np.int64)
        ends = np.cumsum([len(units[k].encode()) for k in plain], dtype=np.int64)
        last = np.searchsorted(np.cumsum(self.a_size[joined]), ends) + 1
        sizes = np.zeros(len(units), np.int64)
        sizes[plain] = np.diff(last, prepend=0)
        others = [e.ids for e in self.a.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)] if rest else []
        sizes[rest] = list(map(len, others))
        tokens = np.zeros(sizes.sum(), np.int64)
        is_plain = np.zeros(len(units), bool)
        is_plain[plain] = True
        of = np.repeat(is_plain, sizes)
        tokens[of] = joined
        tokens[~of] = [i for ids in others for i in ids]
        return tokens, sizes

    def _of_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's tokens of all units; B puts a blank before what it encodes, in place of the unit's own or to be dropped."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        ids = [(i or [self.blank]) if u[0] == " " else i[1:] for u, i in zip(units, ids)]
        return np.array([i for one in ids for i in one], np.int64), np.array(list(map(len, ids)), np.int64)

    def rows(self, units: list[str]) -> np.ndarray:
        """Numbers of the units, valid until the next call."""
        for unit in self.passing:
            del self.known[unit]
        self.passing = []
        if len(self.known) > REMEMBERED // 2 or self.held > 1 << 26:
            self.forget()
        if new := list(set(units) - self.known.keys()):
            self.known.update(zip(new, range(len(self.figures), len(self.figures) + len(new))))
            self.passing = [u for u in new if len(u) > LONGEST_REMEMBERED]
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _learn(self, units: list[str]) -> None:
        (a, n_a), (b, n_b) = self._of_a(units), self._of_b(units)
        same = np.ones(len(units), bool)
        if not b"".join([self.a_bytes[k] for k in a.tolist()]) == b"".join([self.b_bytes[k] for k in b.tolist()]) == "".join(units).encode():
            at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
            for k, u in enumerate(units):
                one = [b"".join([of[i] for i in ids[end - n : end].tolist()]) for of, ids, end, n in ((self.a_bytes, a, at_a[k], n_a[k]), (self.b_bytes, b, at_b[k], n_b[k]))]
                same[k] = one[0] == one[1] == u.encode()
            a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a * same, n_b * same
        unit_a = np.repeat(np.arange(len(units)), n_a)
        # Both vocabularies tell the same bytes, so places count through all units.
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(end_b, end_a - self.a_size[a], side="right")
        links = np.searchsorted(end_b - self.b_size[b], end_a, side="left") - first
        meets_b = np.repeat(first - np.cumsum(links) + links, links) + np.arange(links.sum())
        closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_links = np.bincount(unit_a, links, len(units)).astype(np.int64)
        n_groups = np.bincount(unit_a, closes_a, len(units)).astype(np.int64)
        shown = self._shown(a, b, closes_a, closes_b)
        ends = np.cumsum(np.bincount(unit_a, self.n_digits[a] + 1, len(units)) + np.bincount(np.repeat(np.arange(len(units)), n_b), self.n_digits[b] + 1, len(units))).astype(np.int64)
        self.shown += [shown[s : max(s, e - 1)] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.held += len(shown)
        self.figures = np.concatenate([self.figures, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.same = np.concatenate([self.same, same])
        self.pairs = np.concatenate([self.pairs, (np.repeat(a, links) * self.base + b[meets_b]).astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])

    def _shown(self, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> str:
        """``a1,a2|b1;`` for every group: its tokens of A, then those of B."""
        of_a, of_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b  # groups
        before = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=1))])  # tokens of B in earlier groups
        through = np.cumsum(np.bincount(of_a, minlength=1))  # tokens of A in these and earlier groups
        place = np.concatenate([np.arange(len(a)) + before[of_a], np.arange(len(b)) + through[of_b]])
        tokens, marks = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
        tokens[place] = np.concatenate([a, b])
        marks[place] = np.concatenate([np.where(closes_a, ord("|"), ord(",")), np.where(closes_b, ord(";"), ord(","))])
        size = self.n_digits[tokens]
        ends = np.cumsum(size + 1)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        out[ends - 1] = marks
        for k in range(self.digits.shape[1]):
            has = size > k
            out[(ends - 1 - size)[has] + k] = self.digits[tokens[has], k]
        return out.tobytes().decode()


@cache
def _aligner(folder: str) -> _Aligner:
    return _Aligner(folder)


@dataclass
class Closed:
    """What closed groups, in order, add up to."""

    figures: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    shown: list[str] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    same: bool = True

    def __add__(self, other: Closed) -> Closed:
        pairs, back = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(back, np.concatenate([self.times, other.times]), len(pairs)).astype(np.int64)
        return Closed(self.figures + other.figures, self.shown + other.shown, pairs, times, self.same and other.same)


@dataclass
class Fragment:
    """Open text ``head`` if ``closed`` is None, else open prefix, closed groups and open suffix."""

    head: str
    closed: Closed | None = None
    tail: str = ""


def close(texts: list[list[str]], aligner: _Aligner) -> list[Closed]:
    """The groups of several lists of units."""
    rows = aligner.rows([u for units in texts for u in units])
    of = np.repeat(np.arange(len(texts)), [len(units) for units in texts])
    figures = np.zeros((len(texts), 4), np.int64)
    np.add.at(figures, of, aligner.figures[rows])
    bad = np.zeros(len(texts), bool)
    np.logical_or.at(bad, of, ~aligner.same[rows])
    links = aligner.starts[rows + 1] - aligner.starts[rows]
    at = np.repeat(aligner.starts[rows] - np.cumsum(links) + links, links) + np.arange(links.sum())
    keys, times = np.unique((np.repeat(of, links).astype(np.int64) << 31) | aligner.pairs[at], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << 31)
    pairs = (keys & ((1 << 31) - 1)).astype(np.int32)
    out, place = [], 0
    for k, units in enumerate(texts):
        shown = [";".join([aligner.shown[r] for r in rows[place : place + len(units)].tolist()])] if units else []
        place += len(units)
        out.append(Closed(figures[k], shown, pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]], not bad[k]))
    return out


def fragments(texts: list[str], aligner: _Aligner) -> list[Fragment]:
    """A fragment of each text, whose range may begin and end anywhere."""
    units = [_UNITS.findall(t) for t in texts]
    closed = close([u[1:-1] for u in units], aligner)
    return [Fragment(t) if len(u) < 2 else Fragment(u[0], c, u[-1]) for t, u, c in zip(texts, units, closed)]


def compose(parts: list[Fragment], aligner: _Aligner) -> Fragment:
    """The fragment of neighbouring ranges, in order."""
    seams: list[list[str]] = []  # units between closed stretches
    stretches: list[Closed] = []
    head, open_text = None, ""
    for f in parts:
        open_text += f.head
        if f.closed is None:
            continue
        units = _UNITS.findall(open_text)
        if head is None:
            head, units = units[0] if units else "", units[1:]
        seams.append(units)
        stretches.append(f.closed)
        open_text = f.tail
    units = _UNITS.findall(open_text)
    if head is None:
        if len(units) < 2:
            return Fragment(open_text)
        head, units = units[0], units[1:]
    tail = units.pop() if units else ""
    seams.append(units)
    total = Closed()
    for seam, stretch in zip(close(seams, aligner), [*stretches, Closed()]):
        total = total + seam + stretch
    return Fragment(head, total, tail)


def finish(parts: list[Fragment], aligner: _Aligner) -> list[Closed]:
    """The groups of whole texts: nothing can follow, so what is open is closed."""
    ends = close([_UNITS.findall(f.head) if f.closed is None or f.head else [] for f in parts], aligner)
    tails = close([_UNITS.findall(f.tail) for f in parts], aligner)
    return [a if f.closed is None else a + f.closed + b for f, a, b in zip(parts, ends, tails)]


_CLOSED = "n_a long, n_b long, n_groups long, n_links long, pairs array<int>, times array<long>"
_FRAGMENT = f"is_open boolean, head string, tail string, groups string, same boolean, {_CLOSED}"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *values]).astype(kind.to_pandas_dtype()), kind))


def _closed_columns(found: list[Closed]) -> dict[str, pa.Array]:
    figures = {name: pa.array([int(c.figures[k]) for c in found], pa.int64()) for k, name in enumerate(_FIGURES)}
    return figures | {"pairs": _lists([c.pairs for c in found], pa.int32()), "times": _lists([c.times for c in found], pa.int64())}


def _fragment_columns(found: list[Fragment]) -> dict[str, pa.Array]:
    closed = [f.closed or Closed() for f in found]
    return {
        "is_open": pa.array([f.closed is None for f in found], pa.bool_()), "head": pa.array([f.head for f in found], pa.string()), "tail": pa.array([f.tail for f in found], pa.string()),
        "groups": pa.array([";".join(filter(None, c.shown)) for c in closed], pa.string()), "same": pa.array([c.same for c in closed], pa.bool_()),
    } | _closed_columns(closed)


def _read_fragments(table: pa.Table) -> list[Fragment]:
    out = []
    for r in range(table.num_rows):
        one = {name: table.column(name)[r] for name in table.column_names}
        numbers = {c: one[c].values.to_numpy(zero_copy_only=False) for c in ("pairs", "times")}
        figures = np.array([one[c].as_py() for c in _FIGURES], np.int64)
        shown = [one["groups"].as_py()] if one["groups"].as_py() else []
        closed = None if one["is_open"].as_py() else Closed(figures, shown, numbers["pairs"], numbers["times"], one["same"].as_py())
        out.append(Fragment(one["head"].as_py(), closed, one["tail"].as_py()))
    return out


def _results(found: list[Closed]) -> dict[str, pa.Array]:
    """Columns of whole texts; a text whose tokens do not give back its bytes has none."""
    kept = [c if c.same else Closed() for c in found]
    shown = [";".join(filter(None, c.shown)) for c in kept]
    return _closed_columns(kept) | {"groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown], pa.string())}


def _short(docs: DataFrame, id_col: str, text_col: str, size: int, folder: str) -> DataFrame:
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, end in batched(texts):
                columns = _results(close([_UNITS.findall(f" {t}") if t else [] for t in texts[first:end]], aligner))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns.values()], ["id", *columns])

    rows = docs.where(~is_long(text_col, size)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("part"))
    return rows.mapInArrow(work, f"id {id_type}, {_CLOSED}, groups_sha256 string")


def _long(docs: DataFrame, id_col: str, text_col: str, size: int, folder: str) -> DataFrame:
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    chunks = cut(docs, id_col, text_col, size)
    levels, most = 1, chunks.agg(F.max("chunk")).first()[0] or 0
    while FAN_IN**levels <= most:
        levels += 1
    schema = f"key string, id {id_type}, node long, {_FRAGMENT}"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(folder)
        for batch in batches:
            nodes = batch.column("chunk").to_pylist()
            texts = [t if n else f" {t}" for t, n in zip(batch.column("part").to_pylist(), nodes)]
            for first, end in batched(texts):
                columns = _fragment_columns(fragments(texts[first:end], aligner))
                kept = [batch.column(c).slice(first, end - first) for c in ("key", "id", "chunk")]
                yield pa.RecordBatch.from_arrays([*kept, *columns.values()], ["key", "id", "node", *columns])

    def nodes(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        columns = _fragment_columns([compose(_read_fragments(group), _aligner(folder))])
        above = pa.array([group["node"][0].as_py() // FAN_IN], pa.int64())
        return pa.table([pa.array(group["key"].slice(0, 1).to_pylist(), pa.string()), group["id"].slice(0, 1).combine_chunks(), above, *columns.values()], ["key", "id", "node", *columns])

    def roots(group: pa.Table) -> pa.Table:
        whole = compose(_read_fragments(group.sort_by("node")), _aligner(folder))
        columns = _results(finish([whole], _aligner(folder)))
        return pa.table([group["id"].slice(0, 1).combine_chunks(), *columns.values()], ["id", *columns])

    found = spread(chunks, size).mapInArrow(leaves, schema)
    for _ in range(levels - 1):
        found = found.groupBy("key", F.floor(F.col("node") / FAN_IN).alias("up")).applyInArrow(nodes, schema)
    return found.groupBy("key").applyInArrow(roots, f"id {id_type}, {_CLOSED}, groups_sha256 string")


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, size: int = 1 << 15, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A encodes a blank and the text, B the text (it puts the blank itself), both without special
    tokens, whose strings in a text are plain text.  A link is a token of A and one of B whose
    bytes overlap.  The count of an id pair is the number of rows that hold it linked; ``n_best``
    counts the links whose pair has the highest count of all pairs of its A id, ``count_sum`` adds
    up the counts.  Null and empty texts, and texts that either vocabulary cannot give back byte
    by byte, have zeros and an empty digest.  Texts of more than ``size`` characters are worked on
    in ranges by many tasks.  Repeated rows count each; null ids are kept; an empty table gives no
    rows; other columns are ignored.  The vocabularies are files in the folder ``tokenizers``,
    which every executor must have under one path.
    """
    found = _short(docs, id_col, text_col, size, tokenizers).unionByName(_long(docs, id_col, text_col, size, tokenizers))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    base = _aligner(tokenizers).base
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("rows")), "pair-counts")
    a = F.floor(F.col("pair") / base).cast("int")
    best = counts.groupBy(a.alias("a")).agg(F.max("rows").alias("most"))
    counts = counts.withColumn("a", a).join(best, "a").select("pair", "rows", (F.col("rows") == F.col("most")).alias("is_best"))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("rows")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return found.select("row", "id", *_FIGURES, "groups_sha256").join(sums, "row", "left").select(
        F.col("id").alias(id_col), *_FIGURES, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
