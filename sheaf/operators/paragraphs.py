"""Files as one stream of rows: a heading with the path, then one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import forward_slashes, split_lines

HEADING_STYLE = "Heading1"


def explode_lines(texts: DataFrame) -> DataFrame:
    """One row per line of ``text``, ``line_no`` from 1; other columns are kept."""
    keep = [c for c in texts.columns if c != "text"]
    return texts.select(
        *keep, F.posexplode(split_lines(F.col("text"))).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no") + 1)


def build_paragraphs(texts: DataFrame) -> DataFrame:
    """Paragraph rows of files (bundle_id, source_ord, path, text).

    Heading and lines come out of one explode: the files are read once and nothing is shuffled.
    Rows are ordered by (source_ord, path, line_no) within a bundle; line 0 is the heading.
    """
    heading = forward_slashes(F.col("path"))
    rows = F.concat(F.array(heading), split_lines(F.coalesce("text", F.lit(""))))
    return texts.select(
        "bundle_id", "source_ord", "path", F.posexplode(rows).alias("line_no", "text")
    ).select(
        "bundle_id",
        "source_ord",
        "path",
        "line_no",
        F.when(F.col("line_no") == 0, F.lit(HEADING_STYLE)).alias("style"),
        "text",
    )


def is_heading(style: Column) -> Column:
    """Any style whose name starts with Heading opens a file."""
    return F.coalesce(style.startswith("Heading"), F.lit(False))


def as_stream(paragraphs: DataFrame) -> DataFrame:
    """The columns an unpacker may rely on: bundle, order key, style and text."""
    order = F.struct("source_ord", "path", "line_no").alias("position")
    return paragraphs.select("bundle_id", order, "style", "text")
