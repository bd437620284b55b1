"""MinHash near-duplicate groups with tensored banding.

Each of ``2 * halves`` half-keys combines ``rows`` minima.  A table key joins a
half-key of the first collection with one of the second, so ``halves * diagonals``
tables of ``2 * rows`` minima each need only ``2 * halves * rows`` hash functions
(96 in place of 384 at the defaults).  ``diagonals == halves`` is the full tensor;
fewer diagonals keep most of its recall with far fewer keys: at the defaults a
pair at exactly the threshold of 0.8 meets in no table with probability 1e-4,
one at 0.85 with less than 1e-5 (simulated).  All candidates are verified on the
full shingle sets.

Work is kept linear in hot groups: texts with equal sets collapse to one class first, and a
class is verified against single members of its buckets, never against all of them: first
the one that it meets most often, then one drawn for each bucket in which it is still apart.
Members of larger buckets that then still span several components are compared through a
prefix filter on their full sets, which is exact.  Components are computed once over the
links of the classes, and once over what the prefix filter adds between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import bounds, whole_groups
from .components import components
from .tables import drop, free_name, stored
from .words import chunks, hashes, mix, ngrams, spans

_SEED = 7_420_001


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in chunks(texts):
        starts, ends, rows = spans(data, offsets)
        words = hashes(data, starts, ends, lower=True)
        for k in range(end - first):
            yield np.unique(ngrams(words[rows[k] : rows[k + 1]], n))


def _half_keys(sets: np.ndarray, scale: np.ndarray, shift: np.ndarray, rows: int) -> np.ndarray:
    short = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(scale), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (short[None, at : at + 4096] * scale[:, None] + shift[:, None]).min(axis=1), out=low)
    key = np.zeros(len(scale) // rows, np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[k::rows])
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, ngram: int, halves: int, rows: int) -> DataFrame:
    """(id, n, s1, s2, left, right): set size, 128-bit set identity and the two half-key collections."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    scale = rng.integers(0, 2**32, 2 * halves * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 2**32, 2 * halves * rows, dtype=np.uint64).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for one in _sets(batch.column(1), ngram):
                n.append(len(one))
                for known, new in zip((s1, s2), _identity(one)):
                    known.append(new)
                keys.append(_half_keys(one, scale, shift, rows) if len(one) else np.zeros(2 * halves, np.uint64))
            flat = np.concatenate(keys).view(np.int64).reshape(-1, 2, halves) if keys else np.zeros((0, 2, halves), np.int64)
            at = pa.array(np.arange(0, len(n) * halves + 1, halves, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(s1, np.uint64).view(np.int64)),
                    pa.array(np.array(s2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(at, pa.array(flat[:, 0].ravel())),
                    pa.ListArray.from_arrays(at, pa.array(flat[:, 1].ravel())),
                ],
                names=["id", "n", "s1", "s2", "left", "right"],
            )

    schema = "id long, n long, s1 long, s2 long, left array<long>, right array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def _identity(one: np.ndarray) -> tuple[np.uint64, np.uint64]:
    with np.errstate(over="ignore"):
        return mix(one).sum(dtype=np.uint64), mix(one ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)


def _shingle_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(id, n, shingles) of the rows of (id, s1, text) whose set has the identity ``s1``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_numpy().view(np.uint64)
            sets = list(_sets(batch.column(2), ngram))
            own = np.array([_identity(one)[0] == s for one, s in zip(sets, asked)], bool)
            sets = [one for one, k in zip(sets, own) if k]
            batch = batch.filter(pa.array(own))
            size = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "n", "shingles"])

    return docs.mapInArrow(work, "id long, n long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, inter: int, union: int) -> DataFrame:
    """The pairs (a, b) whose full sets have union * |A and B| >= inter * |A or B|."""
    one = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = pairs.join(one, "b").join(two, "a")
    na, nb = F.col("na"), F.col("nb")
    fits = F.least(na, nb) * union >= F.greatest(na, nb) * inter
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(fits).where(common * union >= (na + nb - common) * inter).select("a", "b")


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _companies(loose: DataFrame, sets: DataFrame, inter: int, union: int) -> DataFrame:
    """(id, own, n, c): classes, their components, set sizes, and the components in whose company they may find links.

    ``loose`` has (id, component).  Two sets of similarity t or more share one of the
    ``n - ceil(t n) + 1`` first shingles of each, in any common order.  Rarest first, the
    shingles that only one text has fill most of a prefix, so texts that merely share a
    passage or an origin rarely meet; and no set can share more than its ``r`` shingles that
    some other text has.  All holders of a shingle meet in the company of the component
    that most of them are in, so a class is a row for each such component and never for each
    of its members; a pair that links across components is in one company at least.
    """
    tokens = sets.join(loose, "id").select("id", "component", "n", F.explode("shingles").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df"))
    shared = tokens.join(often.where("df > 1"), "t")  # the others come first in every prefix
    texts = shared.groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("all"))
    texts = texts.withColumn("r", F.size("all").cast("long")).where(F.col("r") * union >= F.col("n") * inter)
    keep = F.col("r") - F.ceil(F.col("n") * inter / F.lit(union)) + 1
    prefix = texts.select("id", "component", "n", F.explode(F.slice("all", F.lit(1), keep.cast("int"))).alias("x"))
    prefix = stored(prefix.select("id", "component", "n", "x.t"), "prefixes")
    of = prefix.groupBy("t", "component").agg(F.count("*").alias("holders"))
    host = of.groupBy("t").agg(F.count("*").alias("components"), F.max_by("component", "holders").alias("c"))
    met = prefix.join(host.where("components > 1").select("t", "c"), "t")
    return met.select("id", F.col("component").alias("own"), "n", "c").distinct()


def _across(company: DataFrame, sets: DataFrame, inter: int, union: int, budget: int = 1 << 18) -> DataFrame:
    """Pairs (a, b) of components that a link joins, from the members of companies and who asks there.

    A company's askers are of other components than its own; each is compared with all in
    the company that share a shingle with it.  They meet in cells whose two sides hold about
    ``budget`` shingles each (or one longer text), and of a class's links to one component
    the first is enough.
    """
    ask = company.where("own != c")
    asks = F.coalesce(F.sum(F.when(F.col("own") != F.col("c"), F.col("n"))), F.lit(0))
    blocks = company.groupBy("c").agg(F.ceil(asks / budget).cast("int").alias("ab"), F.ceil(F.sum("n") / budget).cast("int").alias("mb")).where("ab > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = ask.join(blocks, "c").withColumn("i", F.pmod(F.xxhash64("id"), F.col("ab")).cast("int")).withColumn("j", every("mb"))
    have = company.join(blocks, "c").withColumn("j", F.pmod(F.xxhash64("id"), F.col("mb")).cast("int")).withColumn("i", every("ab"))
    cell = F.xxhash64("c", "i", "j").alias("cell")
    side = lambda df, k: df.select(cell, "c", "i", "j", F.lit(k).alias("side"), "own", "id")
    rows = side(ask, 0).unionByName(side(have, 1))
    rows = rows.join(sets.select("id", "shingles"), "id").repartition("cell").sortWithinPartitions("cell", "c", "i", "j", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            plain = {c: table.column(c).to_numpy() for c in ("cell", "c", "i", "j", "side", "own", "id")}
            lists = table.column("shingles").combine_chunks()
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            found = []
            edge = bounds(*(plain[c] for c in ("cell", "c", "i", "j")))
            for first, end in zip(edge[:-1], edge[1:]):
                cut = first + int(np.searchsorted(plain["side"][first:end], 1))
                if cut in (first, end):
                    continue
                size, own = np.diff(at[cut : end + 1]), plain["own"][cut:end]
                held = flat[at[cut] : at[end]]
                order = np.argsort(held, kind="stable")  # an inverted list of the cell: its shingles, and who holds each
                held, holder = held[order], np.repeat(np.arange(end - cut), size)[order]
                for k in range(first, cut):
                    mine = flat[at[k] : at[k + 1]]
                    low, high = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
                    many = high - low
                    pick = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    common = np.bincount(holder[pick], minlength=end - cut)
                    linked = (common * union >= (len(mine) + size - common) * inter) & (own != plain["own"][k])
                    other = np.unique(own[linked])
                    found.append(np.stack([np.full(len(other), plain["own"][k]), other]))
            a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 5,
    inter: int = 80,
    union: int = 100,
    halves: int = 16,
    rows: int = 3,
    diagonals: int = 4,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, n_copies) for every row of ``docs``.

    Texts are lower-cased (A-Z) and split at white space; a set holds the distinct
    ``ngram``-word shingles, or the whole sequence of a shorter text.  Texts link when
    ``union * |A and B| >= inter * |A or B|``; ``component_id`` is the smallest id
    reachable, ``kept`` marks it, ``n_copies`` counts the rows with the same set.
    Null and empty texts have no shingles and stay alone, as do rows with a null id
    (their component is null, kept true).  Repeated rows are each returned, with one
    component.  Rows with one id and different texts each follow their own text; two texts
    whose groups have one smallest id are in one component.  Other columns are ignored.
    """
    base = stored(signatures(docs, id_col, text_col, ngram, halves, rows), "signatures")
    live = base.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = live.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    classes = stored(classes, "classes")

    reps = live.join(classes.select(F.col("rep").alias("id"), "n", "s1", "s2"), ["id", "n", "s1", "s2"])
    reps = reps.dropDuplicates(["id", "n", "s1", "s2"])
    table = [(i, (i + d) % halves) for d in range(diagonals) for i in range(halves)]
    keys = reps.select(
        F.col("id").alias("rep"),
        F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("left")[i], F.col("right")[j]) for k, (i, j) in enumerate(table)])).alias("key"),
    )
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(keys.join(shared, "key"), "buckets")  # rows of keys that several classes share
    # The leader of a bucket is the class that meets most others in all of its buckets: the
    # text that a group's copies were made from is closer to each of them than they are.
    weight = stored(buckets.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("met")), "met")
    lead = buckets.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("met", "rep")).alias("lead"))

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = classes.join(weight.select("rep"), "rep").select(F.col("rep").alias("id"), "s1")
    sets = stored(_shingle_sets(ids.join(named, "id").select("id", "s1", "text").distinct(), ngram), "sets")

    # First each class against the leader it meets most often.
    meets = buckets.join(lead, "key").where("rep != lead").groupBy("lead", "rep").agg(F.count("*").alias("n"))
    first = meets.groupBy("rep").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    near = stored(_verified(first.select(F.col("rep").alias("a"), F.col("lead").alias("b")), sets, inter, union), "links")
    # Then, in each bucket, the members apart from one that is drawn anew for each bucket, against it.
    star = near.select("a", "b").dropDuplicates(["a"]).unionByName(near.select(F.col("b").alias("a"), "b").distinct())
    star = star.groupBy("a").agg(F.max_by("b", F.col("a") != F.col("b")).alias("group"))
    member = buckets.join(star.withColumnRenamed("a", "rep"), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    head = member.groupBy("key").agg(F.max_by(F.struct("rep", "group"), F.xxhash64("key", "rep")).alias("h"))
    other = member.join(head, "key").where("h.group != group").select("rep", F.col("h.rep").alias("lead")).select(*_ordered("lead", "rep"))
    more = stored(_verified(other.distinct(), sets, inter, union), "links")
    label = stored(components(near.unionByName(more)), "labels").withColumnRenamed("node", "id")

    # Then whatever still shares a bucket of three or more across components; in one of two, the pair is known.
    large = buckets.where("size > 2").withColumnRenamed("rep", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = large.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    loose = stored(large.join(spread.select("key"), "key").select("id", "component").distinct(), "loose")
    company = stored(_companies(loose, sets, inter, union), "companies")
    joined = components(stored(_across(company, sets, inter, union), "links"))
    last = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("smallest")), "component", "left")
    alone = joined.select(F.col("node").alias("id"), F.col("component").alias("smallest"))  # components of one class have no label
    last = last.select("id", F.coalesce("smallest", "component").alias("smallest")).unionByName(alone)
    last = stored(last.groupBy("id").agg(F.min("smallest").alias("component")), "components")
    drop(sets)

    named = classes.join(last.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "s1", "s2", "n_copies", F.coalesce("component", "rep").alias("component")
    )
    rows_ = base.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    named_row = F.col("id").isNotNull()
    component = F.when(named_row, F.coalesce("component", "id"))
    return rows_.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        F.coalesce(F.when(named_row, F.col("n_copies")), F.lit(1).cast("long")).alias("n_copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which :func:`near_duplicates` keeps one a group, all columns.

    Of rows with one id, the least one (by all columns in order) stays, where its group keeps
    that id.  Rows with a null id stay.
    """
    judged = stored(near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull()).select(id_col, "kept"), "judged")
    ids = judged.groupBy(id_col).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).where("n > 1 or not kept")
    name = free_name(docs, "gone")
    gone = stored(ids.select(F.col(id_col).alias(name), F.col("kept").alias("again")), "gone")
    once = docs.join(gone.select(name), docs[id_col].cast("long") == gone[name], "left_anti")
    again = docs.join(gone.where("again").select(name), docs[id_col].cast("long") == gone[name])
    least = again.groupBy(name).agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return once.unionByName(least.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


#: DuckDB: links by joining all shingles, components by reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS sh FROM d
), k AS (
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END AS h, sh FROM s
), c AS (
  SELECT h, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n, any_value(sh) AS sh FROM k WHERE n > 0 GROUP BY h
), t AS (
  SELECT rep, n, unnest(sh) AS x FROM c
), l AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, seen) AS (
  SELECT rep, rep FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node
), m AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component, k.doc_id) AS component_id, coalesce(m.component, k.doc_id) = k.doc_id AS kept, coalesce(c.copies, 1) AS n_copies
FROM k LEFT JOIN c ON k.h = c.h LEFT JOIN m ON m.node = c.rep
"""
