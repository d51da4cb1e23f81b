"""Chat formatting after cumulative snapshots are collapsed.

A log often holds a conversation again each time it has grown. A conversation is a snapshot if its turns
are the first turns of a longer one; of conversations with the same turns the one of least id counts as the
longest. Each turn gets a hash of its place, role and text (two 64-bit ones); the hash of a prefix is the
exclusive or of its turns' hashes, so it can be rolled in blocks: within a block of ``BLOCK`` turn
numbers by a window, over blocks by a window on one row a block. No window holds a whole conversation of
many turns. Anti-joins on the hash of the whole conversation against hashes of longer prefixes leave the
maximal ones. These are rendered turn by turn, so no conversation has to fit a cell.

Order is by turn (nulls first), then role and text. Repeated rows count once. A null role or text is its own
value to compare and is rendered as an empty string. Rows with a null conv_id form one conversation. Other
columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: The common chat markup.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``place``, 1 for the first of a conversation, and the prefix hashes ``p, q`` that end there."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    own = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rank", F.row_number().over(own))
    start = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = _with(rows, start.select("conv_id", "block", "start")).withColumn("place", F.col("start") + F.col("rank"))
    for name, seed in (("x", 1), ("y", 2)):
        values = F.struct("role", "text", F.col("role").isNull().alias("r"), F.col("text").isNull().alias("t"))
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed), "place", values))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("x", "y")))
    rolled = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _with(rows, sums)
    return rows.select(
        "conv_id", "turn", "role", "text", "place",
        F.bit_xor("x").over(rolled).bitwiseXOR(F.col("x0")).alias("p"),
        F.bit_xor("y").over(rolled).bitwiseXOR(F.col("y0")).alias("q"),
    )


def _with(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), blocks.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.block") == F.col("b.block"))
    return a.join(b, same).select("a.*", *(f"b.{c}" for c in blocks.columns if c not in ("conv_id", "block")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that are no snapshot of another one."""
    size = prefixes.groupBy("conv_id").agg(F.max("place").alias("size"))
    a, b = prefixes.alias("a"), size.alias("b")
    rows = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.conv_id", "place", "p", "q", "size")
    whole = rows.filter("place = size").groupBy("size", "p", "q").agg(F.min(F.struct("conv_id")).getField("conv_id").alias("conv_id"))
    longer = rows.filter("place < size").select(F.col("place").alias("size"), "p", "q").distinct()
    return whole.join(longer, ["size", "p", "q"], "left_anti").select("conv_id")


def format_chat(turns: DataFrame) -> DataFrame:
    """Per turn of a maximal conversation: conv_id, place (from 1), role, and ``rendered``. Joined in order, the
    rendered turns are the chat."""
    prefixes = numbered(turns)
    a, b = prefixes.alias("a"), maximal(prefixes).alias("b")
    kept = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left_semi")
    begin, middle, end = TEMPLATE
    rendered = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    return kept.select("conv_id", "place", "role", rendered.alias("rendered"))


#: The same in SQL, by comparing the written-out prefixes themselves.
SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM turns),
prefixes AS (
  SELECT conv_id, place, md5(string_agg(coalesce(to_json(role)::VARCHAR, 'null') || ' ' || coalesce(to_json(text)::VARCHAR, 'null'), chr(10))
    OVER (PARTITION BY conv_id ORDER BY place)) AS prefix FROM placed),
sizes AS (SELECT conv_id, max(place) AS size FROM placed GROUP BY conv_id),
sized AS (SELECT p.*, s.size FROM prefixes p JOIN sizes s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
whole AS (SELECT size, prefix, min(conv_id) AS conv_id FROM sized WHERE place = size GROUP BY size, prefix),
maximal AS (SELECT conv_id FROM whole w WHERE NOT EXISTS (
  SELECT 1 FROM sized s WHERE s.place < s.size AND s.place = w.size AND s.prefix = w.prefix))
SELECT p.conv_id, p.place, p.role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM placed p JOIN maximal m ON p.conv_id IS NOT DISTINCT FROM m.conv_id
"""
