"""Chat formatting with cumulative-snapshot collapse.

A log that is written again after every turn holds each conversation many times, as prefixes of the longest one. Every turn gets a
rolling hash of the conversation up to it: the running sum of the turns' own hashes, which hold their position (two sums of 64-bit
hashes in decimals, so that nothing overflows). A conversation whose whole hash is a shorter prefix's hash of another one goes by an
anti-join; of equal conversations the one with the smallest id stays. Only those that stay are rendered.

All of it is SQL functions: one shuffle by conversation, one by prefix hash, of distinct hashes, and one for rendering.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusewright.llm._shared import cut, table

START, END = "<|im_start|>", "<|im_end|>"


def _hash(seed: str):
    parts = [F.lit(seed), F.col("pos")]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts).cast("decimal(20,0)")


def collapse(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation that is no proper prefix of another: conv_id, n_turns, n_copies, chat.

    ``n_copies`` counts the conversations equal to it, itself included; its id is the smallest of them. ``chat`` has each turn as
    ``<|im_start|>role\\ntext<|im_end|>\\n``. Turns are ordered by number, then role and text, nulls first; a turn that is
    repeated whole (number, role and text) counts once. A null role is rendered as ``unknown`` and a null text as empty, but
    neither equals its rendering when conversations are compared. Rows with a null id are one conversation, whose id is never the
    smallest. Ids may be of any type that has an order. ``<|im_`` inside a role or text is written ``<| im_``, so that it opens or closes no
    turn. An empty table gives an empty result. Only the four columns are read, so others may have any name; texts are whole.
    """
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    turns = turns.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again")
    turns = turns.withColumn("pos", F.row_number().over(order))
    turns = turns.withColumn("h1", F.sum(_hash("a")).over(order)).withColumn("h2", F.sum(_hash("b")).over(order))
    turns = cut(turns.withColumn("last", F.lead("pos").over(order).isNull()).select("conv_id", "pos", "role", "text", "h1", "h2", "last"))
    prefixes = turns.where("not last").select("pos", "h1", "h2").distinct()
    whole = turns.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")
    mine = turns.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select("k.conv_id", "n_turns", "n_copies", "pos", "role", "text")
    rows = mine.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    safe = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|im_"), F.lit("<| im_"))
    render = lambda t: F.concat(F.lit(START), safe(t["role"], "unknown"), F.lit("\n"), safe(t["text"], ""), F.lit(END + "\n"))
    return rows.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", render), "").alias("chat"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """collapse over all of ``conversations``."""
    return collapse(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM turns),
talks AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM placed GROUP BY conv_id),
prefixes AS (SELECT DISTINCT l[1:k] AS p FROM (SELECT l, unnest(range(1, n)) AS k FROM talks)),
kept AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies, l FROM talks WHERE l NOT IN (SELECT p FROM prefixes) GROUP BY l)
SELECT conv_id, n_turns, n_copies,
  array_to_string(list_transform(l, lambda x: '<|im_start|>' || replace(coalesce(x.r, 'unknown'), '<|im_', '<| im_') || chr(10)
    || replace(coalesce(x.t, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') AS chat
FROM kept
"""
