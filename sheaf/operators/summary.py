"""Counts per bundle, and comparison of a corpus before and after a round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import file_identity
from sheaf.functions.text import split_lines


def pack_summary(classified: DataFrame) -> DataFrame:
    """file_count and binary_skipped per bundle from files with ``is_text``."""
    return classified.groupBy("bundle_id").agg(
        F.count_if("is_text").alias("file_count"), F.count_if(~F.col("is_text")).alias("binary_skipped")
    )


def bundle_table(
    classified: DataFrame, names: DataFrame | None = None, headers: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """The bundles table; names (output_name), headers (header) and errors (error) are optional."""
    out = pack_summary(classified)
    for extra, column in ((headers, "header"), (names, "output_name"), (errors, "error")):
        if extra is None:
            out = out.withColumn(column, F.lit(None).cast("string"))
        else:
            out = out.join(extra.select("bundle_id", column), "bundle_id", "left")
    return out.select(
        "bundle_id", "header", "file_count", "binary_skipped", "output_name", "error"
    )


def _facts(lines: Column, first: Column) -> Column:
    """Number of the last line that is not empty, and hashes of all such lines with their numbers.

    ``first`` is the number of the first of ``lines``. The hashes are combined with exclusive or, so
    those of parts of a file combine to that of the whole.
    """
    numbered = F.transform(lines, lambda x, i: F.struct((first + i).cast("bigint").alias("n"), x.alias("line")))
    full = F.filter(numbered, lambda r: r["line"] != "")

    def hashed(seed: int) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate(full, zero, lambda acc, r: acc.bitwiseXOR(F.xxhash64(F.lit(seed), r["n"], r["line"])))

    return F.struct(
        F.coalesce(F.array_max(full["n"]), F.lit(0)).alias("lines"), hashed(1).alias("x"), hashed(2).alias("y")
    )


def roundtrip_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file: same, changed, missing or added, and the lines it has, empty ones at the end aside.

    ``before`` has (bundle_id, path, text), ``after`` (bundle_id, path, content) and may have
    ``part_no``: all parts of a file make one file. Only hashes and line counts are grouped and
    joined; of several files with one path each side keeps the one of the greatest ``ord``.
    """

    def side(df: DataFrame, text: str, tag: str) -> DataFrame:
        order = F.col("ord") if "ord" in df.columns else F.lit(0)
        # Line 0 is the heading, and a part's number is that of its first row.
        first = F.greatest(F.col("part_no"), F.lit(1)) if "part_no" in df.columns else F.lit(1)
        parts = df.select(
            "bundle_id",
            file_identity(F.col("path")).alias("path"),
            order.alias("ord"),
            _facts(split_lines(F.col(text)), first).alias("f"),
        )
        files = parts.groupBy("bundle_id", "path", "ord").agg(
            F.max("f.lines").alias("lines"), F.bit_xor("f.x").alias("x"), F.bit_xor("f.y").alias("y")
        )
        return files.groupBy("bundle_id", "path").agg(F.max_by(F.struct("lines", "x", "y"), "ord").alias(tag))

    joined = side(before, "text", "b").join(
        side(after, "content", "a"), ["bundle_id", "path"], "full_outer"
    )
    status = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("b").isNull(), "added")
        .when(F.col("a") != F.col("b"), "changed")
        .otherwise("same")
    )
    return joined.select(
        "bundle_id",
        "path",
        status.alias("status"),
        F.col("b.lines").alias("lines_before"),
        F.col("a.lines").alias("lines_after"),
    )
