"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are a bounded sample of the labelled texts, half of each class where there are
enough.  Terms are words and four-letter word beginnings; document frequencies count all
documents, and a text's norm is over all of its terms, whether an example has them or not.
The index stores postings by term and block of similar examples, with the largest weight
of each term in each block; terms of many examples are a matrix in place of postings.  For
a text, the blocks with the largest bounds by these maxima are opened, then all that could
hold a nearer example than those found: the ``neighbours`` nearest are exact.  Their labels
vote, the nearer the more.  A neighbour's vote also grows with the part of the cosine that
telling terms hold (terms whose shares of the two classes of examples differ by many
standard errors), so a common subject alone says little.  The vote is calibrated on the
examples themselves, each left out in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import NOT_LETTERS, chunks, hashes, heads, mix, spans

_HEAD = np.uint64(0x51ED270B9F1A3C55)


def _row_terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row numbers, term hashes) of slices of a string column; terms repeat."""
    for first, end, data, offsets in chunks(texts):
        starts, ends, rows = spans(data, offsets, NOT_LETTERS)
        doc = np.repeat(np.arange(end - first), np.diff(rows))
        words = hashes(data, starts, ends, lower=True)
        longer, cut = heads(data, starts, ends, 4)
        beginning = mix(hashes(data, starts[longer], cut, lower=True) ^ _HEAD)
        yield first, end, np.concatenate([doc, doc[longer]]), np.concatenate([words, beginning])


def _counted(doc: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts of the distinct (row, term) pairs; terms are ranks below n."""
    pair, count = np.unique(doc * n + term, return_counts=True)
    return pair // n, pair % n, count


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of lists, one list after another."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _telling(row: np.ndarray, rank: np.ndarray, y: np.ndarray, n_terms: int, half_z: float) -> np.ndarray:
    """A weight over 0 and under 1 of each term, by the standard errors between its shares of the classes of examples."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    a, b = np.bincount(rank, y[row], minlength=n_terms), np.bincount(rank, 1 - y[row], minlength=n_terms)
    share = (a + b) / max(len(y), 1)
    z2 = (a / n1 - b / n0) ** 2 / (share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    return (z2 + 0.01 * half_z**2) / (z2 + half_z**2)


class Vocabulary:
    """Term hashes of the examples in order, with the inverse document frequency of each."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray):
        self.terms, self.idf = terms, idf

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term, and whether it is there."""
        if not len(self.terms):
            return np.zeros(len(term), np.int64), np.zeros(len(term), bool)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return at, self.terms[at] == term


def _rows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, ranks, counts, the slice's terms by rank) of slices of a string column, by rows; every term of a row once."""
    for first, end, doc, term in _row_terms(texts):
        distinct, rank = np.unique(term, return_inverse=True)
        doc, rank, count = _counted(doc, rank, max(len(distinct), 1))
        yield first, end, doc, rank, count, distinct


def _idf(n_docs: float, df: np.ndarray | float):
    return np.log((n_docs + 1) / (df + 0.5))


class BlockMaxIndex:
    """Inverted lists of unit vectors in blocks, with the largest weight of a term in each block.

    Of terms that a 16th of the vectors hold, up to ``columns`` are rows of a dense matrix in place of lists.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 256, columns: int = 1024):
        # Blocks of examples with the same heaviest terms have low bounds for other texts.
        lead = [(-1, -1) if not len(t) else tuple(t[np.argsort(-w, kind="stable")[:2]].tolist()) for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        self.n_blocks, self.block = max(1, -(-len(vectors) // block)), block
        slot = np.concatenate([np.full(len(vectors[i][0]), s) for s, i in enumerate(self.order)] or [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        held = np.bincount(term, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:columns]
        common = common[(held[common] > 0) & (16 * held[common] >= len(vectors))]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n_blocks * block))
        dense = self.column[term] >= 0
        self.matrix[self.column[term[dense]], slot[dense]] = weight[dense]
        slot, term, weight = slot[~dense], term[~dense], weight[~dense]
        key = term * self.n_blocks + slot // block
        by = np.lexsort((slot, key))
        self.slot, self.weight = slot[by].astype(np.int32), weight[by]
        self.start = np.searchsorted(key[by], np.arange(n_terms * self.n_blocks + 1)).astype(np.int32)
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (term, slot // block), weight)

    def nearest_many(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, telling: np.ndarray | None = None):
        """(row, example, cosine, told) of the k nearest examples with a positive cosine of each row of a sparse matrix.

        The common terms' part comes from one matrix product and is exact in the blocks' bounds.
        For the lists every row opens its quarter of blocks with the largest bounds, then those
        that could still hold a nearer example.  Ties go to the example
        that comes first in the index.  ``told`` is the cosine with each term's part times its
        ``telling`` (1 by default).  ``opened`` holds the blocks opened by the last call.
        """
        n, n_blocks, width = len(start) - 1, self.n_blocks, self.n_blocks * self.block
        row = np.repeat(np.arange(n), np.diff(start))
        tell = weight if telling is None else weight * telling[term]
        column = self.column[term]
        dense = column >= 0
        wide = np.zeros((2 * n, len(self.matrix)))
        wide[row[dense], column[dense]] = weight[dense]
        wide[n + row[dense], column[dense]] = tell[dense]
        sums, told = (wide @ self.matrix).reshape(2, n, width)
        row, term, weight, tell = row[~dense], term[~dense], weight[~dense], tell[~dense]
        bound = sums.reshape(n, n_blocks, self.block).max(axis=2)
        first = np.searchsorted(row, np.arange(n + 1))
        live = np.flatnonzero(np.diff(first))
        if len(live):
            bound[live] += np.add.reduceat(weight[:, None] * self.most[term], first[:-1][live], axis=0)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        opened, bar = np.zeros((n, n_blocks), bool), np.zeros(n)  # bar: of each row, the k-th nearest cosine so far, or less
        for last in (-(-n_blocks // 4), n_blocks):
            open_ = ~opened & (rank < last) & (bound > 0) & (bound >= bar[:, None] - 1e-12)
            opened |= open_
            entry, block = np.nonzero(open_[row])
            at = term[entry] * n_blocks + block
            size = self.start[at + 1] - self.start[at]
            entry, at, size = entry[size > 0], at[size > 0], size[size > 0]
            pick = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size).astype(np.int64) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
            place = np.repeat(row[entry] * width, size) + self.slot[pick]
            part = self.weight[pick]
            sums += np.bincount(place, part * np.repeat(weight[entry], size), minlength=n * width).reshape(n, width)
            told += np.bincount(place, part * np.repeat(tell[entry], size), minlength=n * width).reshape(n, width)
            if width > k:
                bar = np.partition(sums, width - k, axis=1)[:, width - k]
        self.opened = int(opened.sum())
        r, c = np.nonzero((sums > 0) & (sums >= bar[:, None] - 1e-11) & np.repeat(opened, self.block, axis=1))
        cosine, told = sums[r, c], told[r, c]
        by = np.lexsort((c, -np.round(cosine, 12), r))
        r, c, cosine, told = r[by], c[by], cosine[by], told[by]
        keep = np.arange(len(r)) - np.searchsorted(r, np.arange(n + 1))[r] < k
        return r[keep], self.order[c[keep]], cosine[keep], told[keep]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """(slope, shift) of a one-feature logistic fit; a weak prior keeps them near 1 and 0.

    Newton steps are halved until the penalised likelihood falls; the slope stays positive.
    """
    design = np.stack([x, np.ones_like(x)], axis=1)
    sign, mean = 2 * y - 1, np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (design @ w))).sum() + 0.5 * ((w - mean) ** 2).sum())

    coef = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        grad = design.T @ (weight * (p - y)) + (coef - mean)
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(coef - size * step) > loss(coef):
            size /= 2
        coef = coef - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return np.array([max(coef[0], 1e-2), coef[1]])


def _log_odds(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 1e-3, 1 - 1e-3)
    return np.log(v / (1 - v))


#: What the prior counts for among the votes.
PRIOR_WEIGHT = 0.002


class Examples:
    """The index of the examples, their labels and what calibrates their votes."""

    def __init__(self, vocabulary: Vocabulary, telling: np.ndarray, rows, labels: np.ndarray, ids: np.ndarray, prior: float, k: int):
        row, term, count = rows  # by rows
        self.vocabulary, self.telling, self.labels, self.ids, self.k = vocabulary, telling, labels, ids, k
        weight = (1 + np.log(count)) * vocabulary.idf[term]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(labels)))
        weight = weight / np.where(norm > 0, norm, 1.0)[row]
        cut = np.searchsorted(row, np.arange(len(labels) + 1))
        self.index = BlockMaxIndex([(term[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:])], max(1, len(vocabulary.terms)))
        self.coef = np.array([1.0, 0.0])
        if len(labels) and 0 < labels.sum() < len(labels):
            votes = np.zeros(len(labels))
            for at, stop in _batches(cut):
                part = slice(cut[at], cut[stop])
                r, near, cosine, told = self.index.nearest_many(cut[at : stop + 1] - cut[at], term[part], weight[part], k + 1, telling)
                other = near != r + at
                r, near, cosine, told = r[other], near[other], cosine[other], told[other]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, pull = r[first], told[first] ** 2 / (REACH - np.minimum(cosine[first], 1.0))
                n = stop - at
                votes[at:stop] = (np.bincount(r, pull * labels[near[first]], minlength=n) + PRIOR_WEIGHT * prior) / (np.bincount(r, pull, minlength=n) + PRIOR_WEIGHT)
            share = labels.mean()
            self.coef = _logistic(_log_odds(votes), labels, np.where(labels == 1, prior / share, (1 - prior) / (1 - share)))


#: Distinct terms of texts that are scored together, about.
TOGETHER = 1 << 15


def _batches(cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, end row) of the rows that are scored together; ``cut`` are the rows' first terms, with an end mark."""
    at, n = 0, len(cut) - 1
    while at < n:
        stop = max(at + 1, min(int(np.searchsorted(cut, cut[at] + TOGETHER)), at + 256, n))
        yield at, stop
        at = stop


def _lists(parts: list[tuple[np.ndarray, ...]], n: int, kind: pa.ListType) -> pa.Array:
    """A list of structs for each of n rows from (rows in order, a column for each field) parts."""
    fields = list(kind.value_type)
    row = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
    columns = [pa.array(np.concatenate([np.zeros(0, f.type.to_pandas_dtype()), *[p[k + 1] for p in parts]]), f.type) for k, f in enumerate(fields)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=kind)


#: A neighbour's pull is the square of what telling terms hold of its cosine, over this less the cosine.
REACH = 1.05


def _series(row: np.ndarray, cosine: np.ndarray, told: np.ndarray, label: np.ndarray, off: np.ndarray, error: float = 1e-13):
    """(lengths, toxic, all): of each row, its neighbours' pulls as power series in how far a norm is off.

    If every cosine and ``told`` of a row is 1 + u times what is given here, the sums of the pulls are
    (1 + u) ** 2 times the series at u.  They are as long as leaves a relative error of at most
    ``error`` for |u| <= ``off``; without neighbours they are empty.
    """
    n = len(off)
    ratio = cosine / (REACH - cosine)
    most = np.zeros(n)
    np.maximum.at(most, row, ratio)
    q = np.clip(most * off, 1e-30, 1 - 1e-6)
    length = np.where(most > 0, np.ceil(np.log(error) / np.log(q)), 0).astype(np.int64)
    part = told**2 / (REACH - cosine)
    toxic, both = [], []
    for _ in range(int(length.max(initial=0))):
        toxic.append(np.bincount(row, part * label, minlength=n))
        both.append(np.bincount(row, part, minlength=n))
        part = part * ratio
    used = np.arange(len(both)) < length[:, None]
    return length, np.stack(toxic, axis=1)[used] if toxic else np.zeros(0), np.stack(both, axis=1)[used] if both else np.zeros(0)


def _numbers(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """A list of doubles for each of n rows from (lengths, values) parts."""
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]]))])
    assert len(ends) == n + 1
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *[p[1] for p in parts]]), pa.float64()))


#: Distinct terms that a task counts before it passes the counts on.
COUNTED = 1 << 20


def _document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n): how many rows hold each term; the null term counts the rows.  Tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, back = np.unique(np.concatenate([terms, *[t for t, _ in fresh]]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([df, *[c for _, c in fresh]]), minlength=len(every)).astype(np.int64)

        for batch in batches:
            n += batch.num_rows
            for _, _, _, rank, _, distinct in _rows(batch.column(0)):
                fresh.append((distinct, np.bincount(rank, minlength=len(distinct))))
                if sum(len(t) for t, _ in fresh) > COUNTED:
                    terms, df = merged()
                    fresh = []
                    if len(terms) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], names=["term", "n"])
                        terms, df = terms[:0], df[:0]
        terms, df = merged()
        yield pa.RecordBatch.from_arrays([pa.array([None, *terms.view(np.int64)], pa.int64()), pa.array([n, *df], pa.int64())], names=["term", "n"])

    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_on=None,
    examples: int = 2000,
    half_z: float = 5.0,
    neighbours: int = 100,
    evidence: int = 3,
    broadcast_terms: int = 1 << 20,
) -> DataFrame:
    """(id_col, score, predicted, evidence) for every row of ``docs``.

    ``labels`` has the id and a 0/1 label; ``train_on`` is a column condition on it for the
    rows that may be learnt from (all by default).  At most ``examples`` rows are examples,
    chosen by a hash of the id.  A term at ``half_z`` standard errors between the classes
    tells half as much as a certain one.  Document frequencies of up to ``broadcast_terms``
    terms that no example has are broadcast, the most frequent first; where rarer ones than
    these are in more than one document, they are joined to the texts' terms by a shuffle, which carries
sums of votes (see ``_series``) and no neighbours.  Null and empty texts, and texts without a
    word of any example, get the score of no neighbours.  Without labels of both classes every
    score is within 0.001 of the share of label 1 (0.5 without any label).  Repeated rows are scored each;
    of repeated labels the larger counts; null ids are scored but never examples.  Other
    columns are ignored.  An empty table gives no rows; texts of any length are read whole,
    in one task each.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), (F.lit(True) if train_on is None else train_on).alias("use"))
    known = known.where(F.col("use") & F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    known = stored(known, "labels")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(examples // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stored(chosen, "chosen")  # at most `examples` rows, so it may be broadcast

    all_texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms: list[list[np.ndarray]] = []
            for first, end, doc, term in _row_terms(batch.column(2)):
                order = np.lexsort((term, doc))
                doc, term = doc[order], term[order]
                cut = np.searchsorted(doc, np.arange(end - first + 1))
                for a, b in zip(cut[:-1], cut[1:]):
                    terms.append(np.unique(term[a:b], return_counts=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.view(np.int64) for t, _ in terms], pa.list_(pa.int64())), pa.array([c for _, c in terms], pa.list_(pa.int64()))],
                names=["id", "y", "terms", "counts"],
            )

    texts = all_texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "y", "text")
    parsed = stored(texts.mapInArrow(parse, f"id {id_type}, y int, terms array<long>, counts array<long>"), "examples")
    held = parsed.orderBy("id").toArrow()  # at most `examples` rows
    ids, y = held["id"].to_pylist(), held["y"].to_numpy().astype(float)
    row = np.repeat(np.arange(len(ids)), [len(t) for t in held["terms"]])
    terms, rank = np.unique(_flat(held["terms"]).view(np.uint64), return_inverse=True)
    count = _flat(held["counts"])
    tally = stored(_document_frequencies(all_texts.select("text")), "frequencies")
    n_docs = tally.where("term is null").first()
    n_docs = n_docs["n"] if n_docs else 0
    own = parsed.select(F.explode("terms").alias("term")).distinct()
    of_examples = tally.join(F.broadcast(own), "term").toArrow()  # at most the examples' terms
    df = np.zeros(len(terms))
    df[np.searchsorted(terms, of_examples["term"].to_numpy().view(np.uint64))] = of_examples["n"].to_numpy()
    floor = 2
    while tally.where(F.col("n") >= floor).count() > broadcast_terms:
        floor *= 2
    others = tally.where((F.col("n") >= floor) & F.col("term").isNotNull()).toArrow()  # at most broadcast_terms rows
    order = np.argsort(others["term"].to_numpy().view(np.uint64))
    frequent = Vocabulary(others["term"].to_numpy().view(np.uint64)[order], _idf(n_docs, others["n"].to_numpy()[order]))
    single = _idf(n_docs, 1.0)
    vocabulary = Vocabulary(terms, _idf(n_docs, df))
    cut = np.argsort(row, kind="stable")
    examples_ = Examples(vocabulary, _telling(row, rank, y, len(terms), half_z), (row[cut], rank[cut], count[cut]), y, np.array(ids), prior, neighbours)

    near_type = pa.list_(pa.struct([("example", pa.int32()), ("cosine", pa.float64())]))
    rare_type = pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.float64())]))
    # A term whose frequency is only in `tally` has a weight between these; the norm is set half-way.
    least = float(_idf(n_docs, min(floor - 1.0, max(n_docs, 1)))) if floor > 2 else single

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = TaskContext.get().partitionId() << 33, examples_.index
        for batch in batches:
            norm2, most2 = np.ones(batch.num_rows), np.ones(batch.num_rows)  # squared norms: half-way, and with every rare term in one document
            near_of: list[tuple[np.ndarray, ...]] = []
            rare_of: list[tuple[np.ndarray, ...]] = []
            toxic_of: list[tuple[np.ndarray, np.ndarray]] = []
            both_of: list[tuple[np.ndarray, np.ndarray]] = []
            for first, end, doc, rank, count, distinct in _rows(batch.column(1)):
                tf = 1 + np.log(count)
                at, held = vocabulary.find(distinct)
                place, often = frequent.find(distinct)
                often &= ~held
                idf = np.full(len(distinct), single)
                if len(terms):
                    idf[held] = vocabulary.idf[at[held]]
                if len(frequent.terms):
                    idf[often] = frequent.idf[place[often]]
                weight, lone = tf * idf[rank], (~held & ~often)[rank]
                most = np.bincount(doc, weight * weight, minlength=end - first)
                low = np.bincount(doc, np.where(lone, tf * least, weight) ** 2, minlength=end - first)
                if floor > 2:  # else all that is left is in one document
                    rare_of.append((doc[lone] + first, distinct[rank[lone]].view(np.int64), tf[lone]))
                middle = (most + low) / 2
                some = most > 0
                norm2[first:end][some], most2[first:end][some] = middle[some], most[some]
                norm = np.sqrt(norm2[first:end])
                off = np.maximum(norm / np.sqrt(np.where(some, low, 1.0)) - 1, 1 - norm / np.sqrt(most2[first:end]))
                inside = held[rank]
                doc, at, weight = doc[inside], at[rank[inside]], weight[inside] / norm[doc[inside]]
                cut = np.searchsorted(doc, np.arange(end - first + 1))
                for a, b in _batches(cut):
                    part = slice(cut[a], cut[b])
                    r, near, cosine, told = index.nearest_many(cut[a : b + 1] - cut[a], at[part], weight[part], examples_.k, examples_.telling)
                    length, toxic, both = _series(r, np.minimum(cosine, 1.0), told, y[near], off[a:b])
                    toxic_of.append((length, toxic))
                    both_of.append((length, both))
                    shown = np.arange(len(r)) - np.searchsorted(r, r) < evidence
                    near_of.append((r[shown] + first + a, near[shown].astype(np.int32), cosine[shown]))
            keys = np.arange(own, own + batch.num_rows)
            own += batch.num_rows
            n = batch.num_rows
            cols = [batch.column(0), pa.array(keys, pa.int64()), pa.array(norm2), pa.array(most2), _numbers(toxic_of, n), _numbers(both_of, n), _lists(near_of, n, near_type), _lists(rare_of, n, rare_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "own", "norm2", "most2", "toxic", "both", "near", "rare"])

    found = all_texts.mapInArrow(
        search, f"id {id_type}, own long, norm2 double, most2 double, toxic array<double>, both array<double>, near array<struct<example: int, cosine: double>>, rare array<struct<term: long, tf: double>>"
    )
    less = F.lit(0.0)
    if floor > 2:
        # Only the series are joined, not the neighbours: some hundred bytes a row.
        found = stored(found, "neighbours")  # so that a row's number stays its own
        pairs = found.select("own", F.explode("rare").alias("x")).select("own", "x.term", "x.tf")
        idf = F.log((F.lit(float(n_docs)) + 1) / (F.col("n") + 0.5))
        shared = tally.where((F.col("n") > 1) & (F.col("n") < floor))
        over = pairs.join(shared, "term").groupBy("own").agg(F.sum(F.col("tf") ** 2 * (float(single) ** 2 - idf**2)).alias("over"))
        found = found.drop("rare").join(over, "own", "left")
        less = F.coalesce("over", F.lit(0.0))
    found = found.withColumn("scale", F.sqrt(F.col("norm2") / (F.col("most2") - less)))

    # Labels and ids of the examples: at most `examples` of each.
    label_of = F.lit(y.astype(int).tolist()) if len(y) else F.array().cast("array<int>")
    id_of = F.lit([i.item() if id_type == "bigint" else str(i) for i in examples_.ids]) if len(y) else F.array().cast("array<string>")
    shown_id = "long" if id_type == "bigint" else "string"
    at = lambda c: F.col("scale") ** 2 * F.aggregate(F.reverse(c), F.lit(0.0), lambda z, x: z * (F.col("scale") - 1) + x)
    vote = (at("toxic") + PRIOR_WEIGHT * prior) / (at("both") + PRIOR_WEIGHT)
    vote = F.least(F.greatest(vote, F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = F.log(vote / (1 - vote)) * float(examples_.coef[0]) + float(examples_.coef[1])
    shown = F.transform(F.slice("near", 1, evidence), lambda x: F.struct(F.get(id_of, x["example"]).cast(shown_id).alias("id"), (x["cosine"] * F.col("scale")).alias("cosine"), F.get(label_of, x["example"]).cast("int").alias("label")))
    out = found.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-odds))).alias("score"), shown.alias("evidence"))
    return out.select(id_col, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def held_out(id_col: str = "doc_id"):
    """Rows that scores are judged on: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
