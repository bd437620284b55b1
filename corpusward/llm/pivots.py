"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) come from a bounded sample, their number grows with the vectors.
A vector is described by its ``nearest`` closest pivots in order; an inverted list holds, for
a label, a vector length and ``shared`` pivots, the vectors that have all of these among
theirs, so vectors meet exactly if they share so many pivots or more.  Lists with one vector
are dropped before vectors are brought to them.  Every pair of a list is verified by cosine
in double precision, in the one list that its smallest shared pivots name.

Lists longer than ``block`` are cut into blocks and their block pairs dealt to
different tasks.  A task returns, for each vector, the number of links found and
one edge to the smallest member of its local group, never all the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .cells import bounds, whole_groups
from .components import components
from .tables import stored

#: Rows that the pivots are chosen from, at most; and the most pivots of vectors of one length.
SAMPLE = 8192
MOST_PIVOTS = 4096


def n_pivots(n: int) -> int:
    """Pivots for ``n`` vectors: one for 8 of them or more, as a power of two, up to a bound."""
    return min(MOST_PIVOTS if n > 1 << 20 else MOST_PIVOTS // 2, 1 << max(4, (max(n, 1) // 8 - 1).bit_length()))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(rows: np.ndarray, count: int, apart: float, dim: int, seed: int = 7) -> np.ndarray:
    """Unit vectors of ``rows`` in order, each under cosine ``apart`` to those before; random ones fill up."""
    chosen, n = np.zeros((count, dim)), 0
    for x in _unit(rows) if len(rows) else ():
        if n == count:
            break
        if not n or (chosen[:n] @ x).max() < apart:
            chosen[n] = x
            n += 1
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.vstack([chosen[:n], _unit(rng.standard_normal((count - n, dim)))]) if n < count else chosen


def _links_in(rep, cnt, block, piv, unit, list_pivots, cross, least) -> tuple[np.ndarray, np.ndarray]:
    """Links to others and the smallest member of the local group, for the vectors of one list cell."""
    n = len(rep)
    added, root = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(rep, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, 512):
        cos = unit[a : a + 512] @ unit.T
        i, j = np.nonzero(cos >= least)
        i += a
        keep = rank[i] < rank[j]
        if cross:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            both = (piv[x][:, :, None] == piv[y][:, None, :]).any(axis=2)
            # The smallest shared pivots name the pair's list.
            held = np.sort(np.where(both, piv[x], np.iinfo(np.int32).max), axis=1)
            own = (held[:, : len(list_pivots)] == list_pivots).all(axis=1)
            x, y = x[own], y[own]
            np.add.at(added, x, cnt[y])
            np.add.at(added, y, cnt[x])
            while len(x):  # hook roots on smaller ranks until all of these links are inside one group
                rx = np.array([find(k) for k in np.unique(x)])[np.unique(x, return_inverse=True)[1]]
                ry = np.array([find(k) for k in np.unique(y)])[np.unique(y, return_inverse=True)[1]]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                small = np.where(rank[rx] < rank[ry], rx, ry)
                large = np.where(rank[rx] < rank[ry], ry, rx)
                best = np.argsort(-rank[small], kind="stable")
                root[large[best]] = small[best]  # of several, the smallest is written last
    return added, np.array([find(k) for k in range(n)], np.int64) if n else root


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    least: float = 0.93,
    pivots: int | None = None,
    nearest: int = 7,
    shared: int = 2,
    apart: float = 0.5,
    block: int = 1024,
) -> DataFrame:
    """(id_col, n_links, component_id, kept, n_copies) for every row of ``vectors``.

    Vectors of one label and length link at a cosine of ``least`` or more.  Null and zero
    vectors, vectors with null or non-finite components or with a null label (if there is a
    label column) link with nothing.  Rows with equal vectors and labels (repeated rows too)
    are one class that links with itself.  Rows with one id and different vectors each follow
    their own vector; where such an id is the smallest of two classes, these are in one
    component.  A null id is returned with a null component and no links.  Other columns are ignored.  ``pivots`` is the number for each length,
    :func:`n_pivots` of its vectors by default.
    """
    plain = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(label_col) if label_col else F.lit(0)).alias("label"),
        F.transform(v, lambda x: x + F.lit(0.0).cast("float")).alias("v"),  # no negative zeros
    )
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(sound, F.lit(False))
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "label", "v").alias("k2")]
    # A class is told by (rep, k1): one id may be the smallest of several classes.
    classes = base.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    classes = stored(classes.select("rep", *key, "n_copies", F.xxhash64("label").alias("group"), F.size("v").alias("d"), "v"), "vectors")

    by_length = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row a length
    drawn = classes.orderBy(F.xxhash64("rep"), "k1").select("v").limit(SAMPLE).toPandas()["v"]
    points = {}
    for d, n in by_length.items():
        own = [x for x in drawn if len(x) == d]
        count = max(pivots or n_pivots(n), shared)
        points[d] = choose_pivots(np.stack(own).astype(np.float64) if own else np.zeros((0, d)), count, apart, d)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy()
            for d in np.unique(length):
                rows = np.flatnonzero(length == d)
                for at in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    near = _unit(_matrix(part.column("v"), d)) @ points[d].T
                    take = min(nearest, near.shape[1])
                    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
                    ordered = np.take_along_axis(top, order, axis=1).astype(np.int32)
                    piv = pa.ListArray.from_arrays(pa.array(np.arange(0, ordered.size + 1, take, dtype=np.int32)), pa.array(ordered.ravel()))
                    yield part.append_column("ordered", piv)

    index = classes.mapInArrow(describe, StructType([*classes.schema, StructField("ordered", ArrayType(IntegerType()))]))
    index = stored(index.withColumn("piv", F.array_sort("ordered")).drop("ordered"), "index")
    # The lists hold ids only; vectors are brought to those that several share.
    picks = list(combinations(range(nearest), shared))
    named = F.array(*[F.struct(F.lit(c).alias("c"), F.xxhash64("group", "d", *[F.get("piv", F.lit(k)) for k in ks]).alias("name"), F.get("piv", F.lit(ks[-1])).isNotNull().alias("full")) for c, ks in enumerate(picks)])
    post = index.select("rep", "k1", F.inline(named)).where("full").drop("full")
    sizes = post.groupBy("name").agg(F.count("*").alias("size")).where("size > 1")
    post = post.join(sizes, "name")
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    post = post.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep", "k1"), F.col("nb")).cast("int"))
    cells = post.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).select("name", "c", "lo", "hi", "block", "rep", "k1")
    rows = cells.join(index.select("rep", "k1", "d", "n_copies", "piv", "v"), ["rep", "k1"])
    rows = rows.select(F.xxhash64("name", "lo", "hi").alias("cell"), "name", "lo", "hi", "c", "d", "rep", "k1", "block", "n_copies", "piv", "v")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "name", "lo", "hi", "d")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready in whole_groups(batches, "cell"):
            col = {c: ready.column(c).combine_chunks() for c in ready.column_names}
            plain = {c: col[c].to_numpy() for c in ("cell", "name", "lo", "hi", "c", "d", "rep", "k1", "block", "n_copies")}
            edge = bounds(*(plain[c] for c in ("cell", "name", "lo", "hi", "d")))
            out: list[np.ndarray] = []
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a < 2:
                    continue
                s, n = slice(a, b), b - a
                rep, k1 = plain["rep"][s], plain["k1"][s]
                unit = _unit(_matrix(col["v"].slice(a, n), plain["d"][a]))
                piv = col["piv"].slice(a, n).flatten().to_numpy().reshape(n, -1)
                own = piv[0][list(picks[plain["c"][a]])]  # of any member, the list's pivots
                added, root = _links_in(rep, plain["n_copies"][s], plain["block"][s], piv, unit, own, plain["lo"][a] != plain["hi"][a], least)
                hit = added > 0
                if hit.any():
                    out.append(np.stack([rep[hit], rep[root[hit]], added[hit], k1[hit]]))
            if out:
                a, b, n, k = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array(k)], names=["a", "b", "n", "k1"])

    found = stored(rows.mapInArrow(search, "a long, b long, n long, k1 long"), "links")
    label = components(found)
    more = found.groupBy(F.col("a").alias("rep"), "k1").agg(F.sum("n").alias("others"))
    told = (
        index.select("rep", "k1", "k2", "n_copies").join(more, ["rep", "k1"], "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", "n_copies", (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    keyed = base.select("id", *[F.when(usable, k).alias(n) for n, k in zip(("k1", "k2"), key)])
    out = keyed.join(told, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


#: DuckDB: links by comparing all vectors of a label, components by reachability.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r(node, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node
), m AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
), c AS (
  SELECT label, e, count(*) AS copies FROM g GROUP BY label, e
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component AS component_id, m.component = v.vec_id AS kept, coalesce(c.copies, 1) AS n_copies
FROM v JOIN m ON m.node = v.vec_id LEFT JOIN c ON c.label = v.label AND c.e = v.e
"""
