"""Quality classification by co-training two views of a document.

The text view sees hashed words, word beginnings and word shapes.  The metadata view
sees the record (source, language, stated length) and the layout (lines, their lengths,
shares of capitals, digits and symbols) but no words.  Both are logistic regressions.
In each round, both views score every unlabelled text in one pass over all of them; each
view labels those it is surest of, a fixed number of each class, and hands them to the other
view.  In the end each view is calibrated on labelled rows that no round used, and their
log-odds are added with weights fitted on the same rows.  The weights start at one half each
and need evidence to move, and none falls below ``LEAST_WEIGHT``, so neither view drops out.

Training takes a bounded sample of labelled rows and, of each round, a fixed number of
pseudo-labelled ones; every pass goes over whole texts, without shuffling them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, stored
from .words import chunks, hashes, heads, mix, shapes, spans

#: Hashed columns of the text view and of the metadata view's names.
TEXT_DIMS, NAME_DIMS = 1 << 15, 256
#: Norm of the counts below which a text view stays shorter than 1.
SHORT = 6.0
#: Numbers of the metadata view.
LAYOUT = ("bias", "log_chars", "log_words", "log_lines", "mean_word", "mean_line", "capital_share", "digit_share", "symbol_share", "stated_ratio")
_SALTS = {"word": np.uint64(1), "head": np.uint64(0x9E3779B97F4A7C15), "shape": np.uint64(0xC2B2AE3D27D4EB4F)}


@dataclass
class Rows:
    """Both views of some rows: sparse text rows in CSR form, dense metadata rows."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.meta)

    def text_times(self, w: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(self.value * w[self.column])])[self.start])

    def take(self, rows: np.ndarray) -> Rows:
        size = (self.start[1:] - self.start[:-1])[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(self.start[:-1][rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.column[pick], self.value[pick], self.meta[rows])


def _text_view(data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = spans(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(rows))
    longer, cut = heads(data, starts, ends, 4)
    column = np.concatenate([
        mix(hashes(data, starts, ends, lower=True) ^ _SALTS["word"]),
        mix(hashes(data, starts[longer], cut, lower=True) ^ _SALTS["head"]),
        mix(shapes(data, starts, ends) ^ _SALTS["shape"]),
    ]) & np.uint64(TEXT_DIMS - 1)
    pair, count = np.unique(np.concatenate([doc, doc[longer], doc]) * TEXT_DIMS + column.astype(np.int64), return_counts=True)
    at, column, value = pair // TEXT_DIMS, (pair % TEXT_DIMS).astype(np.int32), 1 + np.log(count)
    norm = np.sqrt(np.bincount(at, value * value, minlength=n))
    value = value / np.maximum(norm, SHORT)[at]  # a text of a few words says little
    value = value.astype(np.float32)
    return np.searchsorted(at, np.arange(n + 1)), column, value, starts, rows


def views(texts: pa.Array, sources: list, langs: list, stated: np.ndarray) -> Iterator[tuple[int, int, Rows]]:
    """(first row, end row, Rows) of slices of the columns of a batch."""
    for first, end, data, offsets in chunks(texts):
        n = end - first
        start, column, value, starts, rows = _text_view(data, offsets)
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)  # noqa: E731, B023
        chars = total((data & 0xC0) != 0x80)
        words = np.diff(rows).astype(float)
        lines = total(data == 10) + 1
        some = np.maximum(chars, 1)
        letter = ((data >= 65) & (data < 91)) | ((data >= 97) & (data < 123)) | (data >= 128)
        digit = (data >= 48) & (data < 58)
        space = (data == 32) | ((data >= 9) & (data < 14))
        meta = np.zeros((n, len(LAYOUT) + NAME_DIMS))
        told = np.where(np.isfinite(stated[first:end]), stated[first:end], chars)
        meta[:, : len(LAYOUT)] = np.stack([
            np.ones(n), np.log1p(chars) / 8, np.log1p(words) / 6, np.log1p(lines) / 4, np.minimum(chars / np.maximum(words, 1), 40) / 10,
            np.log1p(chars / lines) / 6, 4 * total((data >= 65) & (data < 91)) / some, 4 * total(digit) / some,
            4 * total(~(letter | digit | space)) / some, np.clip(np.log((told + 1) / (chars + 1)), -3, 3),
        ], axis=1)
        for i in range(n):
            for name in (f"source={sources[first + i]}", f"lang={langs[first + i]}"):
                meta[i, len(LAYOUT) + zlib.crc32(name.encode("utf-8", "replace")) % NAME_DIMS] = 0.5
        yield first, end, Rows(start, column, value, meta)


def _fit(score, grad, size: int, y: np.ndarray, weight: np.ndarray, decay: float, steps: int) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient steps from zero."""
    w = np.zeros(size)
    ahead, momentum = w.copy(), 1.0
    scale = weight / weight.sum()
    rate = 8.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(score(ahead), -30, 30)))
        new = ahead - rate * (grad(scale * (p - y)) + decay * ahead)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


class Views:
    """The two fitted views, their calibration and their combination."""

    def __init__(self):
        self.text = np.zeros(TEXT_DIMS + 1)
        self.meta = np.zeros(len(LAYOUT) + NAME_DIMS)
        self.mean = np.zeros(len(LAYOUT))
        self.scale = np.ones(len(LAYOUT))
        self.calibrated = {"text": (1.0, 0.0), "meta": (1.0, 0.0)}
        self.joint = np.array([0.5, 0.5, 0.0])
        self.share = 0.5
        self.trained = False

    def _meta(self, rows: Rows) -> np.ndarray:
        x = rows.meta.copy()
        x[:, : len(LAYOUT)] = np.clip((x[:, : len(LAYOUT)] - self.mean) / self.scale, -8, 8)
        x[:, 0] = 1
        return x

    def fit_text(self, rows: Rows, y: np.ndarray) -> None:
        row = np.repeat(np.arange(len(rows)), np.diff(rows.start))
        score = lambda w: rows.text_times(w) + w[-1]
        grad = lambda g: np.append(np.bincount(rows.column, rows.value * g[row], minlength=TEXT_DIMS), g.sum())
        self.text = _fit(score, grad, TEXT_DIMS + 1, y, _balanced(y), 1e-4, 120)

    def fit_meta(self, rows: Rows, y: np.ndarray) -> None:
        self.mean = rows.meta[:, : len(LAYOUT)].mean(axis=0)
        self.scale = np.maximum(rows.meta[:, : len(LAYOUT)].std(axis=0), 1e-3)
        x = self._meta(rows)
        x_norm = max(1.0, float((x * x).sum(axis=1).mean()))
        root = np.sqrt(x_norm / 4)
        self.meta = _fit(lambda w: (x / root) @ w, lambda g: (x / root).T @ g, x.shape[1], y, _balanced(y), 1e-3, 200) / root

    def logits(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        return rows.text_times(self.text) + self.text[-1], self._meta(rows) @ self.meta

    def score(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of label 1: by text, by metadata, and both."""
        if not self.trained:
            return (np.full(len(rows), self.share),) * 3
        t, m = self.logits(rows)
        (a, b), (c, d) = self.calibrated["text"], self.calibrated["meta"]
        t, m = np.clip(a * t + b, -20, 20), np.clip(c * m + d, -20, 20)
        both = self.joint[0] * t + self.joint[1] * m + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (t, m, both))


#: The least weight of a view's log-odds in the combination.
LEAST_WEIGHT = 0.1


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, least: float = 1e-3) -> np.ndarray:
    """Logistic weights of the columns of ``x``, ``least`` or more, and a shift; a prior of strength ``ridge`` keeps them near 1 / columns and 0.

    Newton steps are halved until the penalised likelihood falls.
    """
    design = np.column_stack([np.clip(x, -20, 20), np.ones(len(x))])
    mean = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0.0)
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (design @ w)).sum() + 0.5 * ridge * ((w - mean) ** 2).sum())

    coef = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        grad = design.T @ (p - y) + ridge * (coef - mean)
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(coef))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(coef - size * step) > loss(coef):
            size /= 2
        coef = coef - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    coef[:-1] = np.maximum(coef[:-1], least)
    return coef


def _start(out: Views, labelled: Rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers of the labelled rows to fit on and to calibrate on (every fifth); None if there is nothing to tell apart."""
    if not len(y) or not 0 < y.sum() < len(y):
        out.share = float(y.mean()) if len(y) else 0.5
        return None
    kept = np.arange(len(y)) % 5 == 0
    if not 0 < y[kept].sum() < kept.sum() or not 0 < y[~kept].sum() < (~kept).sum():
        return np.arange(len(y)), np.arange(len(y))
    return np.flatnonzero(~kept), np.flatnonzero(kept)


def co_train(labelled: Rows, y: np.ndarray, surest, rounds: int = 3, per_round: int = 200, sure: float = 0.9) -> Views:
    """Fit the views; every fifth labelled row is kept for calibration only.

    ``surest(views, k, bar)`` gives the views of unlabelled rows, and for "text" and "meta"
    the row numbers and labels that the other view is surest of: at most ``k`` a class, with
    log-odds at ``bar`` or beyond.
    """
    out = Views()
    split = _start(out, labelled, y)
    if split is None:
        return out
    own, check = split
    base, base_y = labelled.take(own), y[own].astype(float)
    pool, none = labelled.take(np.zeros(0, np.int64)), (np.zeros(0, np.int64), np.zeros(0))
    given = {"text": none, "meta": none}
    for turn in range(rounds + 1):
        for name, fit in (("text", out.fit_text), ("meta", out.fit_meta)):
            rows, pseudo = given[name]
            fit(_joined(base, pool.take(rows)), np.concatenate([base_y, pseudo]))
        if turn < rounds:
            pool, given = surest(out, per_round * (turn + 1), float(np.log(sure / (1 - sure))))
    out.trained = True
    rows, truth = labelled.take(check), y[check].astype(float)
    t, m = out.logits(rows)
    out.calibrated = {"text": tuple(_calibrate(t[:, None], truth)), "meta": tuple(_calibrate(m[:, None], truth))}
    (a, b), (c, d) = out.calibrated["text"], out.calibrated["meta"]
    out.joint = _calibrate(np.stack([a * t + b, c * m + d], axis=1), truth, ridge=10.0, least=LEAST_WEIGHT)
    return out


def _joined(a: Rows, b: Rows) -> Rows:
    return Rows(
        np.concatenate([a.start, a.start[-1] + b.start[1:]]), np.concatenate([a.column, b.column]),
        np.concatenate([a.value, b.value]), np.concatenate([a.meta, b.meta]),
    )


def _packed(frame) -> Rows:
    """Rows of a frame that holds the views as bytes."""
    size = np.array([len(c) // 4 for c in frame["column"]], np.int64)
    meta = np.frombuffer(b"".join(frame["meta"]), np.float32).astype(float).reshape(len(frame), len(LAYOUT) + NAME_DIMS)
    return Rows(
        np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.frombuffer(b"".join(frame["column"]), np.int32), np.frombuffer(b"".join(frame["value"]), np.float32), meta
    )


class _Columns:
    """The columns of ``docs`` that the views read, under names of their own."""

    def __init__(self, docs: DataFrame, id_col, text_col, source_col, lang_col, chars_col):
        none = F.lit(None)
        self.used = [
            F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
            (F.col(source_col) if source_col else none).cast("string").alias("source"),
            (F.col(lang_col) if lang_col else none).cast("string").alias("lang"),
            (F.col(chars_col) if chars_col else none).cast("double").alias("stated"),
        ]
        self.id_type = docs.schema[id_col].dataType.simpleString()


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Rows]]:
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    stated = col["stated"].to_numpy(zero_copy_only=False).astype(float)
    yield from views(col["text"], col["source"].to_pylist(), col["lang"].to_pylist(), stated)


def _extracted(rows: DataFrame, id_type: str) -> DataFrame:
    """(id, y, column, value, meta): the views of (id, y, text, source, lang, stated), as bytes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, part in _unpack(batch):
                cut = list(zip(part.start[:-1], part.start[1:]))
                column, value = part.column.astype(np.int32), part.value.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first),
                        pa.array([column[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([m.tobytes() for m in part.meta.astype(np.float32)], pa.binary()),
                    ],
                    names=["id", "y", "column", "value", "meta"],
                )

    rows = rows.select("id", "y", "text", "source", "lang", "stated")
    return rows.mapInArrow(extract, f"id {id_type}, y int, column binary, value binary, meta binary")


def _surest(rows: DataFrame, model: Views, k: int, bar: float, id_type: str) -> DataFrame:
    """(id, kind): of all ``rows``, the at most ``k`` surest ids of each kind; of equally sure ones the least ids.

    Kinds 0 and 1 are labels 0 and 1 by the text view, 2 and 3 those by the metadata view.
    Each task keeps its own ``k`` surest, shares of the ids the surest of all tasks.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * 4
        for batch in batches:
            for first, end, part in _unpack(batch):
                ids = batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                for view, z in enumerate(model.logits(part)):
                    for kind, far in ((2 * view, -z), (2 * view + 1, z)):
                        hit = far >= bar
                        name, far = ids[hit], far[hit]
                        if best[kind] is not None:
                            name, far = np.concatenate([best[kind][0], name]), np.concatenate([best[kind][1], far])
                        top = np.lexsort((name, -far))[:k]
                        best[kind] = name[top], far[top]
        for kind, kept in enumerate(best):
            if kept is not None and len(kept[0]):
                yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(np.full(len(kept[0]), kind)), pa.array(kept[1])], names=["id", "kind", "sure"])

    found = rows.mapInArrow(score, f"id {id_type}, kind long, sure double").groupBy("id", "kind").agg(F.max("sure").alias("sure"))
    order = [F.desc("sure"), "id"]
    share = Window.partitionBy("kind", "share").orderBy(*order)
    found = found.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(share)).where(F.col("n") <= k)
    return found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("n") <= k).select("id", "kind")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    lang_col: str | None = "lang", chars_col: str | None = "n_chars", label_col: str = "quality", train_on=None,
    labelled: int = 2500, rounds: int = 3, per_round: int = 200,
) -> Views:
    """The co-trained views of ``docs``; see :func:`classify_quality`."""
    columns = _Columns(docs, id_col, text_col, source_col, lang_col, chars_col)
    rows = docs.select(*columns.used)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), (F.lit(True) if train_on is None else train_on).alias("use"))
    known = known.where(F.col("use") & F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    own = rows.select("id").where(F.col("id").isNotNull()).distinct().join(known, "id").orderBy(F.xxhash64("id"), "id").limit(labelled)
    own = stored(own, "chosen")  # at most `labelled` rows, so it may be broadcast

    def held(chosen: DataFrame):
        """Ids, labels and views of the chosen rows (of repeated ids one, the least by its views)."""
        sample = stored(_extracted(rows.join(F.broadcast(chosen), "id"), columns.id_type), "views")
        frame = sample.groupBy("id", "y").agg(F.min(F.struct("column", "value", "meta")).alias("v")).select("id", "y", "v.*").orderBy(F.xxhash64("id"), "id").toPandas()
        return frame["id"].to_numpy(), frame["y"].to_numpy(float), _packed(frame)

    def surest(model: Views, k: int, bar: float):
        free = rows.where(F.col("id").isNotNull()).join(F.broadcast(own.select("id")), "id", "left_anti")
        picked = stored(_surest(free, model, k, bar, columns.id_type), "surest")  # at most 4 k rows
        chosen = picked.groupBy("id").agg(F.expr("int(sum(shiftleft(1, int(kind))))").alias("y"))
        _, kinds, pool = held(chosen)
        kinds = kinds.astype(np.int64)
        pick = lambda view: np.concatenate([np.flatnonzero(kinds >> (2 * view + y) & 1) for y in (1, 0)])
        mark = lambda view: np.concatenate([np.full(int((kinds >> (2 * view + y) & 1).sum()), float(y)) for y in (1, 0)])
        return pool, {"meta": (pick(0), mark(0)), "text": (pick(1), mark(1))}

    _, y, own_rows = held(own)
    return co_train(own_rows, y, surest, rounds, per_round)


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    lang_col: str | None = "lang", chars_col: str | None = "n_chars", label_col: str = "quality", train_on=None,
    labelled: int = 2500, rounds: int = 3, per_round: int = 200, threshold: float = 0.3,
) -> DataFrame:
    """(id_col, text_score, meta_score, score, kept) for every row of ``docs``.

    Scores are chances of label 1.  At most ``labelled`` labelled rows are learnt from, chosen
    by a hash of the id; ``train_on`` is a column condition on ``labels`` that limits them.
    All rows but these are candidates for pseudo-labels; of each class a view gives
    ``per_round`` more in every round.  The driver holds the views of those rows, at most 260 kB
    each.  Null texts count as empty and null metadata as a name of its own.  Without labels
    of both classes every score is the share of label 1 (0.5 without any).  Repeated rows are
    scored each; of repeated labels the larger counts, and an id with several texts is learnt
    from by one of them; null ids are scored but not learnt from.  Other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, source_col, lang_col, chars_col, label_col, train_on, labelled, rounds, per_round)
    columns = _Columns(docs, id_col, text_col, source_col, lang_col, chars_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, part in _unpack(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *map(pa.array, model.score(part))],
                    names=["id", "text_score", "meta_score", "score"],
                )

    out = docs.select(*columns.used).mapInArrow(score, f"id {columns.id_type}, text_score double, meta_score double, score double")
    return out.select(F.col("id").alias(id_col), "text_score", "meta_score", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    lang_col: str | None = "lang", chars_col: str | None = "n_chars", threshold: float = 0.3, **options,
) -> DataFrame:
    """The rows of ``docs`` that :func:`classify_quality` keeps, all columns; texts are not shuffled."""
    model = fit(docs, labels, id_col, text_col, source_col, lang_col, chars_col, **options)
    columns = _Columns(docs, id_col, text_col, source_col, lang_col, chars_col)
    view = F.struct(*columns.used)
    name, row = free_name(docs, "view"), free_name(docs, "row")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.RecordBatch.from_struct_array(batch.column(1))
            good = np.zeros(batch.num_rows, bool)
            for first, end, part in _unpack(seen):
                good[first:end] = model.score(part)[2] >= threshold
            yield batch.select([0]).filter(pa.array(good))

    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), view.alias(name))
    kept = both.mapInArrow(keep, both.select(row).schema)
    return kept.select(*[F.col(f"{row}.`{c}`") for c in docs.columns])
