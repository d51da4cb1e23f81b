"""Paths that two sources of one bundle share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_paths(files: DataFrame, counts: Column | None = None) -> DataFrame:
    """Repeated paths: bundle_id, path, copies and repeat_ord, the source that repeats it first.

    Reads names only. Counts are summed before the shuffle, and the second copy is found by a
    ranked window cut at two rows, which Spark also applies before the shuffle, so a path with
    endless copies sends a few rows per task. ``counts`` says which rows count; it is used as a
    value, not as a filter, so a costly one is not moved below a join that has already thinned out
    ``files``.
    """
    names = files.select(
        "bundle_id", "path", "source_ord", (F.lit(True) if counts is None else counts).alias("counts")
    )
    copies = names.groupBy("bundle_id", "path").agg(F.count_if("counts").alias("copies")).filter("copies > 1")
    order = Window.partitionBy("bundle_id", "path").orderBy(F.desc("counts"), "source_ord")
    second = (
        names.withColumn("rank", F.row_number().over(order))
        .filter("rank <= 2")
        .filter("rank = 2")
        .select("bundle_id", "path", F.col("source_ord").alias("repeat_ord"))
    )
    return copies.join(second, ["bundle_id", "path"])


def first_duplicate(files: DataFrame, counts: Column | None = None) -> DataFrame:
    """Per bundle the repeat met first in the order of (source_ord, path)."""
    found = duplicate_paths(files, counts)
    first = F.min(F.struct("repeat_ord", "path"))
    return found.groupBy("bundle_id").agg(
        first["path"].alias("path"), F.count("*").alias("repeated_paths")
    )


def reject_duplicates(files: DataFrame) -> DataFrame:
    """Files of the bundles without a repeated path; a bundle that has one is left out whole."""
    bad = duplicate_paths(files).select("bundle_id").distinct()
    return files.join(bad, "bundle_id", "left_anti")
