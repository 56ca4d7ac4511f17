"""Chat formatting with collapse of cumulative snapshots, in Catalyst expressions only.

Logs often hold a conversation several times, each time some turns longer. Every
turn extends a rolling hash of its conversation's prefix (two xor sums of 64-bit
hashes salted by position, a window that streams over the turns). Equal
conversations are folded to the smallest id; an anti-join against the distinct proper
prefixes of all conversations drops the snapshots. Both sides are combined before the
shuffle, so a first turn that all conversations share is one row a task. What
remains is rendered, one row a conversation.

Turns are ordered by turn number (null first), role, text; repeated rows count as
turns. A turn without an id belongs to no other: it is a conversation of one turn, with a null id
where no equal conversation has one, and is never put into a window with the others. Null role or text render as empty,
though they differ from empty ones in the hashes. Very long texts are hashed and rendered whole.
Only conv_id, turn, role and text are read; further columns, whatever their names, are not. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphline.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def render(role: Column, text: Column) -> Column:
    """One turn: ``<|im_start|>role\\ntext<|im_end|>\\n``."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(f"{END}\n"))


def _hash(salt: str, pos: Column) -> Column:
    return F.xxhash64(F.lit(salt), pos, F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2, last for each turn with an id: the rolling hashes of the prefix that ends there."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    by = Window.partitionBy("conv_id").orderBy(*order)
    nth = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", "role", "text", F.row_number().over(by).alias("pos"), F.lead(F.lit(False), 1, True).over(by).alias("last")
    )
    # the order stays that of the first window: no second shuffle or sort by content
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = lambda salt: F.bit_xor(_hash(salt, F.col("pos"))).over(upto)
    return nth.select("conv_id", "pos", "last", rolling("a").alias("h1"), rolling("b").alias("h2"))


def loose(turns: DataFrame) -> DataFrame:
    """pos, h1, h2, role, text, n: the distinct turns without an id, as conversations of one turn."""
    one = F.lit(1)
    each = turns.where("conv_id IS NULL").select(one.alias("pos"), _hash("a", one).alias("h1"), _hash("b", one).alias("h2"), "role", "text")
    return each.groupBy("pos", "h1", "h2", "role", "text").agg(F.count("*").alias("n"))


def maximal(known: DataFrame, single: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2, n_copies (equal conversations, itself included) of the conversations that stay; ``known``: prefixes()."""
    key = ["pos", "h1", "h2"]
    whole = known.where("last").select("conv_id", *key, F.lit(1).alias("n")).unionByName(single.select(F.lit(None).cast("bigint").alias("conv_id"), *key, "n"))
    whole = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_copies"))
    proper = known.where("NOT last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", *key, "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of every maximal conversation."""
    turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    single = loose(turns)
    kept = cut(maximal(prefixes(turns), single))  # a row a conversation, no texts
    mine = turns.join(kept.where("conv_id IS NOT NULL").select("conv_id", "n_copies"), "conv_id")
    # a struct sorts as the window does: nulls first, then by value
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    named = (
        mine.groupBy("conv_id")
        .agg(sorted_turns.alias("turns"), F.first("n_copies").alias("n_copies"))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            "n_copies",
            F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "").alias("chat"),
        )
    )
    nameless = kept.where("conv_id IS NULL").join(single.drop("n"), ["pos", "h1", "h2"])
    return named.unionByName(nameless.select("conv_id", F.lit(1).cast("bigint").alias("n_turns"), "n_copies", render(F.col("role"), F.col("text")).alias("chat")))


SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, [{{'r': role, 't': text}}] FROM conversations WHERE conv_id IS NULL),
p AS (SELECT DISTINCT list_slice(turns, 1, unnest(range(1, len(turns)))) AS pre FROM c),
e AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns FROM c GROUP BY turns)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: '{START}' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '{END}' || chr(10)), '') AS chat
FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = e.turns)
"""
