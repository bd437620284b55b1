"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold one conversation many times, once after each turn.  A rolling
hash of the turns names every prefix of a conversation; a conversation whose full
hash is a proper prefix of a longer one is dropped by an anti-join, and of equal
conversations the smallest id stays.  Those kept are rendered to a chat template.

The prefix hash is the position-tagged sum of two 64-bit turn hashes, kept in four
32-bit lanes whose sums cannot overflow, so it is a running window sum and never an
array of all turns.  Positions come from blocks of turn numbers (turns without a number: of
roles and first characters): a window inside the blocks and one over the block totals, so a
conversation with a large share of all rows is spread over many tasks.

Only hashes of turns take part until it is known which conversations stay; texts are
shuffled once, to the blocks of those.  Texts decide the order of turns of one number, so
such turns are looked up beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

LANES = ("h0", "h1", "h2", "h3")
#: Placed around a turn: (before the role, between role and text, after the text).
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")


def _lanes(*cols: Column) -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64(F.lit(1), *cols), F.xxhash64(*cols, F.lit(2))
    return [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]


BLOCK = ["conv", "b", "r", "p"]


def _blocked(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` with the names of their blocks (b, r, p), in the order of the turns, and two hashes of each turn."""
    lone = F.col("turn").isNull()
    first = lambda c, what: F.when(lone, F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), what))).otherwise("")
    content = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    return turns.withColumns({
        "b": F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62)), "r": first("role", F.col("role")), "p": first("text", F.substring("text", 1, 2)),
        "t1": F.xxhash64(F.lit(1), *content), "t2": F.xxhash64(*content, F.lit(2)),
    })


def _ranked_ties(light: DataFrame, turns: DataFrame) -> DataFrame:
    """(BLOCK, turn, t1, t2, tie): of turns that share a number in a conversation, their order by role and text."""
    shared = light.groupBy(*BLOCK, F.coalesce("turn", F.lit(-1)).alias("n"), F.col("turn").isNull().alias("lone")).agg(F.count("*").alias("many")).where("many > 1").drop("many")
    met = turns.withColumns({"n": F.coalesce("turn", F.lit(-1)), "lone": F.col("turn").isNull()}).join(shared, [*BLOCK, "n", "lone"])
    order = Window.partitionBy(*BLOCK, "n", "lone").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return met.select(*BLOCK, "n", "lone", "t1", "t2", F.dense_rank().over(order).alias("tie")).distinct()


def prefixes(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(hashes, blocks) of (conv, turn, role, text).

    ``hashes`` has (conv, pos, n_turns, lanes): the lanes of the prefix that ends at each
    distinct turn.  ``blocks`` has (BLOCK, skip, n_turns, n_blocks): turns before each block.
    """
    turns = _blocked(turns, block)
    light = stored(turns.select(*BLOCK, "turn", "t1", "t2").distinct(), "turns")
    key = {"n": F.coalesce("turn", F.lit(-1)), "lone": F.col("turn").isNull()}
    rows = light.withColumns(key).join(_ranked_ties(light, turns), [*BLOCK, "n", "lone", "t1", "t2"], "left")
    inner = Window.partitionBy(*BLOCK).orderBy(F.col("turn").asc_nulls_last(), F.coalesce("tie", F.lit(1)))
    rows = stored(rows.select(*BLOCK, "t1", "t2", F.row_number().over(inner).cast("long").alias("rn")), "turns")
    before = Window.partitionBy("conv").orderBy("b", "r", "p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*BLOCK).agg(F.count("*").alias("size"))
    every = Window.partitionBy("conv")
    blocks = stored(blocks.select(*BLOCK, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"), F.sum("size").over(every).alias("n_turns"), F.count("*").over(every).alias("n_blocks")), "blocks")

    rows = rows.join(blocks, BLOCK).withColumn("pos", F.col("skip") + F.col("rn"))
    rows = rows.select(*BLOCK, "pos", "n_turns", "n_blocks", *[h.alias(n) for h, n in zip(_lanes("pos", "t1", "t2"), LANES)])
    running = Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*BLOCK, "pos", "n_turns", "n_blocks", *[F.sum(n).over(running).alias(n) for n in LANES])
    # Only conversations of several blocks add the sums of the blocks before.
    last = rows.where("n_blocks > 1").groupBy(*BLOCK).agg(*[F.max_by(n, "pos").alias(n) for n in LANES])
    last = last.select(*BLOCK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b{n}") for n in LANES])
    rows = rows.join(last, BLOCK, "left")
    return stored(rows.select("conv", "pos", "n_turns", *[(F.coalesce(F.col(f"b{n}"), F.lit(0)) + F.col(n)).alias(n) for n in LANES]), "hashes"), blocks


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that are no proper prefix of another.

    ``hashes`` has (conv, pos, n_turns, lanes).  Equal conversations are one row, under the smallest id.
    """
    full = hashes.where("pos = n_turns").groupBy("n_turns", *LANES).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = hashes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), *LANES)
    return full.join(inner, ["n_turns", *LANES], "left_anti").select("conv", "n_turns", "n_copies")


def format_chats(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: tuple[str, str, str] = CHATML,
    part_turns: int = 256,
    turn_block: int = 4096,
) -> DataFrame:
    """(conv_col, n_turns, n_copies, part, n_part_turns, rendered) of every maximal conversation.

    Turns are ordered by turn number (nulls last), then role and text, so ties have one
    order; rows that repeat a turn exactly count once.  A null role or text renders as
    the empty string but differs from it in comparisons.  Rows with a null conversation id
    belong to no conversation and are left out.  A conversation is rendered in parts of
    ``part_turns`` turns, numbered from 0; joined in order they are the whole.  Other
    columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    ).where(F.col("conv").isNotNull())
    hashes, blocks = prefixes(turns, turn_block)
    keep = stored(maximal(hashes).select("conv", "n_copies"), "kept")
    places = blocks.join(keep, "conv")
    begin, middle, end = (F.lit(x) for x in template)
    piece = F.concat(begin, F.coalesce("role", F.lit("")), middle, F.coalesce("text", F.lit("")), end)
    texts = _blocked(turns, turn_block).select(*BLOCK, "turn", "role", "text")
    order = Window.partitionBy(*BLOCK).orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    pos = (F.col("skip") + F.dense_rank().over(order)).alias("pos")
    told = ["conv", "n_turns", "n_copies", "part"]

    def parts(of: DataFrame, whole: bool) -> DataFrame:
        """Parts of the conversations; where a part may lie in several blocks, these are put together."""
        shown = texts.join(of, BLOCK).select(*BLOCK, "n_turns", "n_copies", pos, piece.alias("piece"))
        shown = shown.withColumn("part", F.floor((F.col("pos") - 1) / part_turns).cast("long"))
        pieces = shown.groupBy(*BLOCK, *told[1:]).agg(F.array_sort(F.collect_set(F.struct("pos", "piece"))).alias("pieces"))
        if whole:
            return pieces.select(*told, "pieces")
        return pieces.groupBy(*told).agg(F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"))

    out = parts(places.where("n_blocks = 1"), True).unionByName(parts(places.where("n_blocks > 1"), False))
    return out.select(
        F.col("conv").alias(conv_col), "n_turns", "n_copies", "part",
        F.size("pieces").cast("long").alias("n_part_turns"),
        F.array_join(F.col("pieces.piece"), "").alias("rendered"),
    )


#: DuckDB: the same by comparing whole prefixes as lists.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), p AS (
  SELECT conv_id, pos, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t
), f AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY n_turns, prefix
), kept AS (
  SELECT conv_id, n_turns, n_copies FROM f WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT prefix FROM p WHERE pos < n_turns) i WHERE i.prefix = f.prefix)
)
SELECT k.conv_id, k.n_turns, k.n_copies, CAST((t.pos - 1) // 256 AS BIGINT) AS part, count(*) AS n_part_turns,
       string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY ALL
"""
