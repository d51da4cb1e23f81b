"""Paragraphs back to files, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import trim_runs
from sheaf.operators.segment import (
    PART_BYTES,
    PART_SPAN,
    drop_empty_heading,
    fold_files,
    fold_stream,
    heading_files,
    last_write_wins,
    rank_stream,
    ranked_files,
    stop_at_first_error,
    validate_headings,
)


def _decide(names: DataFrame, on_error: str, order: str) -> DataFrame:
    """Names of the files that are written, by bad paths and repeated paths."""
    if on_error == "stop":
        names = stop_at_first_error(names, order=order)
    elif on_error == "skip":
        names = names.filter("error IS NULL")
    else:
        raise ValueError(f"on_error: {on_error}")
    return last_write_wins(names, order=order)


def unpack_stream(
    stream: DataFrame,
    on_error: str = "stop",
    compat_trim: bool = False,
    span: int = PART_SPAN,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Files of a stream (bundle_id, seq, style, text): bundle_id, seg_no, part_no, heading, path, content.

    ``on_error`` stop keeps what comes before the first bad path of a bundle, skip keeps all good
    ones; of several files with one path the last stays. All of this is decided on heading rows before
    any text is folded. ``compat_trim`` trims both ends of every line, as a reader that drops
    indentation does.
    """
    if on_error not in ("stop", "skip"):
        raise ValueError(f"on_error: {on_error}")
    if compat_trim:
        stream = stream.withColumn("text", trim_runs(F.col("text")))
    ranked = rank_stream(stream, span)
    kept = _decide(ranked_files(ranked), on_error, "seg_seq").drop("error")
    folded = fold_stream(stream, ranked, kept, part_bytes)
    return folded.select("bundle_id", "seg_no", "part_no", "heading", "path", "content")


def unpack(
    paragraphs: DataFrame, on_error: str = "stop", span: int = PART_SPAN, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Files of a paragraph table: bundle_id, source_ord, part_no, heading, path, content.

    The table names the file of every row. Which files are written is decided on heading rows; the
    rows of those are then folded by file and block, and the text is shuffled once.
    """
    heads = paragraphs.filter("line_no = 0").select(
        "bundle_id",
        F.struct("source_ord", F.col("path").alias("file")).alias("place"),
        F.coalesce("text", F.lit("")).alias("heading"),
    )
    kept = _decide(validate_headings(drop_empty_heading(heads)), on_error, "place").select(
        "bundle_id", "place.source_ord", F.col("place.file").alias("path"), "heading", F.col("path").alias("target")
    )
    folded = fold_files(paragraphs, span, part_bytes, kept)
    return folded.select("bundle_id", "source_ord", "part_no", "heading", F.col("target").alias("path"), "content")


def unpack_report(stream: DataFrame) -> DataFrame:
    """Per bundle the files a stopping unpack writes and the error it meets, from headings only."""
    names = heading_files(stream)
    errors = names.filter("error IS NOT NULL").groupBy("bundle_id").agg(
        F.min(F.struct("seg_seq", "error"))["error"].alias("error")
    )
    written = stop_at_first_error(names).groupBy("bundle_id").agg(F.count("*").alias("file_count"))
    return written.join(errors, "bundle_id", "full_outer").select(
        "bundle_id", F.coalesce("file_count", F.lit(0)).alias("file_count"), "error"
    )
