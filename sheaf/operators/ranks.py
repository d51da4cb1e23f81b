"""Dense ranks for rows that only have an order, and blocks of rows cut by rank.

Positions may have gaps of any width, so nothing here is sized by their values. Narrow rows (no text)
are range-partitioned by (bundle_id, seq), sorted and numbered where they lie; the sizes of the partitions, a
handful of numbers each, are added up on the driver and give every partition its offset. Blocks are
consecutive ranks that begin where a file or a part of one begins, so none straddles two blocks. Where a row
belongs is looked up among the first rows of blocks, at most ``MAX_BLOCKS`` of them, by a binary search
that is an expression: rows with their text need no join to find their block.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.binding import let
from sheaf.session import shared_dir

MAX_BLOCKS = 10_000
_LOCAL = 33  # monotonically_increasing_id() keeps the row of a partition in this many bits


@dataclass
class Ranked:
    """``rows``: bundle_id, seq, is_heading, has_text, rank, seg_no (0 before the first heading), seg_seq (position of the
    heading), at (rows since the heading) and ``first`` (begins a file or a part). ``bounds``: first rows of blocks but the first."""

    rows: DataFrame
    bounds: list[tuple]

    def block(self, bundle: Column, seq: Column) -> Column:
        """The block of a row: how many bounds are not after it."""
        if not self.bounds:
            return F.lit(0)
        fields = {f.name: f.dataType for f in self.rows.schema.fields}
        kind = T.StructType([T.StructField("b", fields["bundle_id"]), T.StructField("s", fields["seq"])])
        as_json = json.dumps([{"b": b, "s": s} for b, s in self.bounds], default=str)  # decimals go as text
        known = F.from_json(F.lit(as_json), T.ArrayType(kind))  # constant, so it is read once
        steps = F.sequence(F.lit(1), F.lit(len(self.bounds).bit_length()))

        def search(row: Column) -> Column:
            def halve(r: Column, _: Column) -> Column:
                middle = F.shiftright(r["lo"] + r["hi"], 1)
                after = F.get(known, middle) <= row
                narrowed = F.when(after, F.struct((middle + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(
                    F.struct(r["lo"].alias("lo"), middle.alias("hi"))
                )
                return F.when(r["lo"] < r["hi"], narrowed).otherwise(r)

            start = F.struct(F.lit(0).alias("lo"), F.lit(len(self.bounds)).alias("hi"))
            return F.reduce(steps, start, halve)["lo"]

        return let(F.struct(bundle.cast(fields["bundle_id"]).alias("b"), seq.cast(fields["seq"]).alias("s")), search)


def _written(df: DataFrame, label: str) -> DataFrame:
    where = shared_dir(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def _carried(parts: list, kind: T.StructType) -> list[tuple]:
    """What every partition goes on from: rows before it and the state of the bundle that is still open."""
    out, offset = [], 0
    is_open, bundle, start, seg_seq, heads = False, None, None, None, 0
    for p in sorted(parts, key=lambda p: p.part):
        out.append((p.part, offset, is_open, bundle, start, seg_seq, heads))
        last = p.last
        if not (is_open and last.first_idx == 0 and last.bundle_id == bundle):
            start, seg_seq, heads = offset + last.first_idx, None, 0
        if last.heads:
            start, seg_seq = offset + last.head["idx"], last.head["seq"]
        is_open, bundle, heads, offset = True, last.bundle_id, heads + last.heads, offset + p.n
    return out


def rank_rows(flags: DataFrame, span: int, max_blocks: int = MAX_BLOCKS) -> Ranked:
    """Rank rows (bundle_id, seq, is_heading, has_text) by bundle and position. Parts of a file begin every ``span`` rows.

    ``seq`` is unique within its bundle. Further narrow columns pass through.
    """
    spark = flags.sparkSession
    order = ["bundle_id", "seq"]
    # Range partitioning reads its input twice, to sample and to deal; so that text is read once, narrow rows are written first.
    flags = _written(flags, "flags")
    dealt = flags.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written before it is used twice, so that both uses see the same partitions.
    numbered = _written(dealt.withColumn("id", F.monotonically_increasing_id()), "numbered").withColumns(
        {"part": F.shiftright("id", _LOCAL).cast("int"), "idx": F.col("id").bitwiseAND((1 << _LOCAL) - 1)}
    )
    per_bundle = numbered.groupBy("part", "bundle_id").agg(
        F.min("idx").alias("first_idx"),
        F.count("*").alias("n"),
        F.count_if("is_heading").alias("heads"),
        F.max(F.when(F.col("is_heading"), F.struct("idx", "seq"))).alias("head"),
    )
    parts = (
        per_bundle.groupBy("part")
        .agg(F.sum("n").alias("n"), F.max_by(F.struct("bundle_id", "first_idx", "heads", "head"), "first_idx").alias("last"))
        .collect()  # a row a partition
    )
    kind = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("offset", T.LongType()),
            T.StructField("is_open", T.BooleanType()),
            T.StructField("open_bundle", flags.schema["bundle_id"].dataType),
            T.StructField("open_start", T.LongType()),
            T.StructField("open_seq", flags.schema["seq"].dataType),
            T.StructField("open_heads", T.LongType()),
        ]
    )
    carry = spark.createDataFrame(_carried(parts, kind), kind)
    group = Window.partitionBy("part", "bundle_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("is_open") & F.col("bundle_id").eqNullSafe(F.col("open_bundle"))
    head = F.max(F.when(F.col("is_heading"), F.struct("idx", "seq"))).over(group)
    seen = numbered.join(carry, "part").withColumns(
        {"rank": F.col("offset") + F.col("idx"), "head": head, "heads": F.count_if("is_heading").over(group), "begin": F.min("idx").over(group), "goes_on": goes_on}
    )
    start = F.coalesce(F.col("offset") + F.col("head.idx"), F.when(F.col("goes_on"), F.col("open_start")), F.col("offset") + F.col("begin"))
    rows = seen.select(
        *flags.columns,
        "rank",
        (F.col("heads") + F.when(F.col("goes_on"), F.col("open_heads")).otherwise(0)).alias("seg_no"),
        F.coalesce("head.seq", F.when(F.col("goes_on"), F.col("open_seq"))).alias("seg_seq"),
        (F.col("rank") - start).alias("at"),
    ).withColumn("first", F.col("at") % span == 0)
    rows = _written(rows, "ranked")
    total = sum(p.n for p in parts)
    size = max(span, -(-total // max_blocks))
    bounds = []
    if total > size:
        found = rows.filter("first").groupBy(F.floor(F.col("rank") / size).alias("block")).agg(F.min_by(F.struct(*order), "rank").alias("at"))
        bounds = [(r["at"]["bundle_id"], r["at"]["seq"]) for r in found.orderBy("block").collect()][1:]
    return Ranked(rows, bounds)
