"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated 3-word windows of whole
texts.  The fertility rules run public vocabularies over the words: characters per
token, the share of byte-fallback tokens and the entropy of a text's tokens, over the
whole text and over windows of :data:`WINDOW` tokens (their mean and the least of them),
which do not grow with the text.  Each figure has a rejection band per language (or per
script, where a row has no language).  The verdict is that of the base rules and these
bands; symbols and repeated lines are counted and judge nothing.

Bands left open come from the corpus itself: the median of all documents of the
language, give or take ``width`` times the median distance from it, and never tighter
than ``least_width`` says.  Figures are counted on a grid of thousandths, so the medians are
exact on it, take a bounded number of rows a language and are the same in every run.

The vocabularies are files in a folder that every executor must have under the same path
(``tokenizers``, /opt/tokenizers by default; on a cluster, ship it with the job or mount it).

Words hold no white space and the vocabularies never join pieces across it, so a text's
tokens are those of its words; a task encodes each distinct word of a batch once.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import stored
from .words import chunks, hashes, mix, ngrams, spans

TOKENIZERS = "/opt/tokenizers"
SYMBOLS = b"#*$%&|<>"
#: Distinct words whose tokens a task remembers.
REMEMBERED = 1 << 17
FIGURES = ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy", "window_entropy", "least_window_entropy")
#: Tokens of a window; the last window of a text ends with it, shorter texts have none.
WINDOW = 64
#: Half-widths that no learned band goes below.
LEAST_WIDTH = {"chars_per_token": 0.35, "chars_per_byte_token": 0.35, "fallback_share": 0.05, "token_entropy": 1.5, "window_entropy": 0.24, "least_window_entropy": 0.5}
#: First code points and names of the scripts told apart.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"))


@cache
def _piece_model(folder: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / "piece_bpe_32k.model"))
    bytes_ = np.array([model.IsByte(i) for i in range(model.GetPieceSize())])
    return model, bytes_


@cache
def _byte_model(folder: str):
    import tiktoken

    lines = (Path(folder) / "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Words:
    """Tokens of words, remembered by the words' hashes; ``both`` also counts those of the byte vocabulary."""

    def __init__(self, folder: str, both: bool = True):
        self.folder, self.both = folder, both
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)  # of each word's tokens, with an end mark
        self.tokens = np.zeros(0, np.int32)
        self.n_bytes = np.zeros(0, np.int32)
        self.n_byte_tokens = np.zeros(0, np.int32)
        self.sorted, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def ranks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of the words in this memory, learning those it lacks."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at, known = self._find(distinct)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            text = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[fresh]]
            model, is_byte = _piece_model(self.folder)
            ids = model.encode(text, num_threads=1)
            encode = _byte_model(self.folder).encode_ordinary if self.both else None
            flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
            size = np.array([len(x) for x in ids], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            n_bytes = np.diff(np.concatenate([[0], np.cumsum(is_byte[flat])])[bounds])
            self.tokens = np.concatenate([self.tokens, flat])
            self.n_bytes = np.concatenate([self.n_bytes, n_bytes.astype(np.int32)])
            self.n_byte_tokens = np.concatenate([self.n_byte_tokens, np.array([len(encode(" " + w)) for w in text] if encode else np.zeros(len(text)), np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + bounds[1:]])
            new = distinct[fresh]  # in order, so they are merged into those known
            place = np.searchsorted(self.sorted, new)
            self.sorted = np.insert(self.sorted, place, new)
            self.order = np.insert(self.order, place, np.arange(len(self.keys), len(self.keys) + len(new)))
            self.keys = np.concatenate([self.keys, new])
            at, _ = self._find(distinct)
        return at[back]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return self.order[place], self.sorted[place] == keys


def _per_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the marks ``rows``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[rows])


def _run_logs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted ``code`` and c log2 c of their counts c."""
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
    count = np.diff(new).astype(float)
    return code[new[:-1]], count * np.log2(count)


def _windows(token: np.ndarray, token_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and least token entropy of each row's windows, NaN for rows with less than a window of tokens."""
    size = np.diff(token_rows)
    many = np.where(size >= WINDOW, -(-size // WINDOW), 0)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = token_rows[row] + np.minimum(nth * WINDOW, size[row] - WINDOW)
    held = np.sort(token[start[:, None] + np.arange(WINDOW)].astype(np.int64), axis=1)
    code, logs = _run_logs(((np.arange(len(row)) << 20)[:, None] | held).ravel())
    entropy = math.log2(WINDOW) - np.bincount(code >> 20, logs, minlength=len(row)) / WINDOW
    least = np.full(len(size), np.inf)
    np.minimum.at(least, row, entropy)
    mean = np.bincount(row, entropy, minlength=len(size)) / np.maximum(many, 1)
    return np.where(many > 0, mean, np.nan), np.where(many > 0, least, np.nan)


def _measure(data, offsets, memory: _Words) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = spans(data, offsets)
    keys = hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(rows))
    out = {"n_words": np.diff(rows)}

    lead = (data & 0xC0) != 0x80  # first bytes of code points
    solid = np.zeros(len(data) + 1, np.int64)
    solid[starts] += 1
    solid[ends] -= 1
    inside = np.cumsum(solid)[:-1] > 0
    # A word that ends where the next text's first word starts leaves no gap; it is still inside.
    out["word_chars"] = _per_row(offsets, lead & inside)
    out["n_symbols"] = _per_row(offsets, np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))

    breaks = data == 0x0A
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(breaks) + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    edge = np.append(np.flatnonzero(breaks), len(data))
    line_end = np.minimum(edge[np.searchsorted(edge, line_start)], offsets[line_doc + 1])
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    line_key = mix(hashes(data, line_start, line_end) ^ mix(line_doc.astype(np.uint64)))
    _, first = np.unique(line_key, return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)

    repeated = np.zeros(len(keys), bool)
    if len(keys) >= 3:
        window = ngrams(keys, 3)
        own = doc[:-2] == doc[2:]
        at = np.flatnonzero(own)
        window = mix(window[at] ^ mix(doc[at].astype(np.uint64)))
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = _per_row(rows, repeated)

    word = memory.ranks(data, starts, ends, keys) if len(keys) else np.zeros(0, np.int64)
    size = memory.start[word + 1] - memory.start[word] if len(keys) else word
    total = np.concatenate([[0], np.cumsum(size)])
    token_rows = total[rows]
    n_tokens = np.diff(token_rows)
    pick = np.repeat(memory.start[word] - total[:-1], size) + np.arange(total[-1]) if len(keys) else word
    token = memory.tokens[pick]
    code = np.sort((np.repeat(np.arange(n), n_tokens) << 20) | token)
    code, logs = _run_logs(code)
    some = np.maximum(n_tokens, 1)
    per_doc = np.bincount(code >> 20, logs, minlength=n)
    out["n_tokens"] = n_tokens
    byte_tokens = _per_row(rows, memory.n_byte_tokens[word])
    has = n_tokens > 0
    out["chars_per_token"] = np.where(has, out["word_chars"] / some, np.nan)
    out["chars_per_byte_token"] = np.where(has, out["word_chars"] / np.maximum(byte_tokens, 1), np.nan)
    out["fallback_share"] = np.where(has, _per_row(rows, memory.n_bytes[word]) / some, np.nan)
    out["token_entropy"] = np.where(has, np.maximum(np.log2(some) - per_doc / some, 0), np.nan)
    out["window_entropy"], out["least_window_entropy"] = _windows(token, token_rows)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_tokens")
_MEASURES = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FIGURES])


def _language(text_col: str, lang_col: str | None) -> Column:
    """The language, or ``script:`` and the script of the text's first letter where there is none."""
    point = F.ascii(F.substring(F.regexp_replace(F.col(text_col), "[\\x00-\\x40]+", ""), 1, 1))
    name = F.lit("none")
    for low, script in SCRIPTS:
        name = F.when(point >= low, script).otherwise(name)
    script = F.concat(F.lit("script:"), name)
    return F.coalesce(F.col(lang_col).cast("string"), script) if lang_col else script


def _measured(rows: DataFrame, tokenizers: str) -> DataFrame:
    """(kept, lang, COUNTS, FIGURES) of (kept, lang, text), in one pass, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words(tokenizers)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                out = _measure(data, offsets, memory)
                cols = [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first)]
                cols += [pa.array(out[c], pa.int64()) for c in COUNTS]
                cols += [pa.array(out[c], pa.float64(), from_pandas=True) for c in FIGURES]
                yield pa.RecordBatch.from_arrays(cols, names=["kept", "lang", *COUNTS, *FIGURES])

    return rows.mapInArrow(work, StructType([rows.schema["kept"], *StructType.fromDDL(f"lang string, {_MEASURES}")]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, lang, COUNTS, FIGURES) of every row, from one pass over the whole texts, without a shuffle.

    Where there is no language, ``lang`` is ``script:`` and the script of the text's
    first letter.  Figures are null for texts without words; null texts count as empty.
    """
    rows = docs.select(F.col(id_col).alias("kept"), _language(text_col, lang_col).alias("lang"), F.col(text_col).alias("text"))
    return _measured(rows, tokenizers).withColumnRenamed("kept", "id")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) of every row by the piece vocabulary, from one pass, without a shuffle; null texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words(tokenizers, both=False)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                starts, ends, rows = spans(data, offsets)
                keys = hashes(data, starts, ends)
                word = memory.ranks(data, starts, ends, keys) if len(keys) else np.zeros(0, np.int64)
                n = _per_row(rows, memory.start[word + 1] - memory.start[word] if len(keys) else word)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def base_failed():
    """The base verdict, as a column."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


#: Languages up to which the table of bands is broadcast.
BROADCAST_LANGUAGES = 1000


def _small(df: DataFrame) -> DataFrame:
    """A table of one row a language, written, and to be broadcast if there are few."""
    df = stored(df, "languages")
    return F.broadcast(df) if df.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else df


#: Steps of a figure's grid to 1.
GRID = 1000


def learned_bands(figures: DataFrame, width: float, least_width: dict[str, float]) -> DataFrame:
    """(lang, low and high of each figure) over all rows that pass the base rules."""
    sound = figures.where(~base_failed()).select("lang", F.posexplode(F.array(*[F.round(F.col(c) * GRID) / GRID for c in FIGURES])).alias("k", "v"))
    grid = sound.where("v is not null").groupBy("lang", "k", "v").agg(F.count("*").alias("n"))
    middle = grid.groupBy("lang", "k").agg(F.percentile("v", 0.5, F.col("n")).alias("mid"))
    away = grid.join(middle, ["lang", "k"]).groupBy("lang", "k", "mid").agg(F.percentile(F.abs(F.col("v") - F.col("mid")), 0.5, F.col("n")).alias("off"))
    least = F.element_at(F.array(*[F.lit(float(least_width[c])) for c in FIGURES]), F.col("k") + 1)
    half = F.greatest(F.col("off") * width, least)
    bands = away.select("lang", "k", (F.col("mid") - half).alias("low"), (F.col("mid") + half).alias("high"))
    ends = [F.max(F.when(F.col("k") == k, F.col(end))).alias(f"{c}_{end}") for k, c in enumerate(FIGURES) for end in ("low", "high")]
    return bands.groupBy("lang").agg(*ends)


def _judged(figures: DataFrame, bands, width: float, least_width: dict[str, float]) -> DataFrame:
    """``figures`` with base_failed, failed_figures and passes."""
    if bands is None:
        limits = _small(learned_bands(figures, width, least_width).withColumnRenamed("lang", "band"))
        rows = figures.join(limits, F.col("lang") == F.col("band"), "left")
        low = {c: F.col(f"{c}_low") for c in FIGURES}
        high = {c: F.col(f"{c}_high") for c in FIGURES}
    else:
        rows, low, high = figures, {}, {}
        for c in FIGURES:
            for side, at in ((low, 0), (high, 1)):
                default = bands.get("*", {}).get(c, (None, None))[at]
                value = F.lit(default).cast("double")
                for name, own in bands.items():
                    if name != "*" and c in own:
                        value = F.when(F.col("lang") == name, F.lit(own[c][at]).cast("double")).otherwise(value)
                side[c] = value
    fails = [F.when((F.col(c) < low[c]) | (F.col(c) > high[c]), F.lit(c)) for c in FIGURES]
    judged = rows.withColumns({"base_failed": base_failed(), "failed_figures": F.array_compact(F.array(*fails))})
    return judged.withColumn("passes", ~F.col("base_failed") & (F.size("failed_figures") == 0))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: dict[str, dict[str, tuple[float, float]]] | None = None,
    width: float = 6.0,
    least_width: dict[str, float] = LEAST_WIDTH,
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """(id_col, counts, base_failed, figures, failed_figures, kept) for every row of ``docs``.

    ``bands`` gives (low, high) of figures by language or ``script:`` name, with ``*`` for
    the rest; None learns them from the corpus.  A row is kept if the base rules and every
    band hold; ``failed_figures`` names the figures outside theirs.  Null and empty texts
    fail the base rules.  Repeated rows and null ids are judged alike, row by row; other
    columns are ignored.  An empty table gives no rows.  Texts of any length are read
    whole, in one task each.
    """
    figures = stored(measure(docs, id_col, text_col, lang_col, tokenizers), "figures")
    rows = _judged(figures, bands, width, least_width)
    return rows.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", "n_lines", "n_tokens", *FIGURES, "failed_figures", F.col("passes").alias("kept"))


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: dict[str, dict[str, tuple[float, float]]] | None = None,
    width: float = 6.0,
    least_width: dict[str, float] = LEAST_WIDTH,
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns.

    Rows are judged as they are, whatever their ids; they are written once beside their
    figures and read again for the verdict, so texts are never shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    figures = stored(_measured(docs.select(row.alias("kept"), _language(text_col, lang_col).alias("lang"), F.col(text_col).alias("text")), tokenizers), "judged")
    rows = _judged(figures, bands, width, least_width).where("passes")
    return rows.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
