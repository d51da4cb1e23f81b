"""Keep text files and decode them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.charsets import DEFAULT_ENCODINGS, decode_with
from sheaf.functions.sniff import (
    is_text_reason,
    sniff_prefix,
    sniff_reason,
    utf16_scores,
    utf32_scores,
)
from sheaf.session import java_charsets


def classify_text(files: DataFrame, encodings: Sequence[str] = DEFAULT_ENCODINGS) -> DataFrame:
    """Add ``reason`` (the test that settled it) and ``is_text``.

    Looks at ``head``, the stored first bytes, if there is such a column, else at ``content``.
    """
    start = F.col("head" if "head" in files.columns else "content")
    with java_charsets(files.sparkSession):
        files = files.withColumn("reason", sniff_reason(start, encodings))
    return files.withColumn("is_text", is_text_reason(F.col("reason")))


def text_filter(files: DataFrame, encodings: Sequence[str] = DEFAULT_ENCODINGS) -> DataFrame:
    return classify_text(files, encodings).filter("is_text").drop("is_text")


def decode_text(
    files: DataFrame, encodings: Sequence[str] = DEFAULT_ENCODINGS, detect_wide: bool = False
) -> DataFrame:
    """Replace ``content`` by ``text`` and ``encoding``.

    Strict UTF-8 comes first, so two-byte ASCII without a mark comes out with zero characters in
    it; ``detect_wide`` uses the sniffed byte order (needs ``reason``) and gives clean text.
    """
    wide = None
    if detect_wide:
        head = sniff_prefix(F.col("content"))
        le16, be16 = utf16_scores(head)
        le32, be32 = utf32_scores(head)
        wide = F.when(
            F.col("reason") == "utf16", F.when(le16 > be16, "UTF-16LE").otherwise("UTF-16BE")
        ).when(F.col("reason") == "utf32", F.when(le32 > be32, "UTF-32LE").otherwise("UTF-32BE"))
    with java_charsets(files.sparkSession):
        decoded = decode_with(F.col("content"), encodings, wide)
        return (
            files.withColumn("decoded", decoded)
            .withColumns({"text": F.col("decoded.text"), "encoding": F.col("decoded.encoding")})
            .drop("decoded", "content")
        )


def encoding_audit(files: DataFrame, encodings: Sequence[str] = DEFAULT_ENCODINGS) -> DataFrame:
    """Files and bytes per bundle, deciding test and encoding, with subtotals (nulls) per level."""
    known = decode_text(classify_text(files, encodings), encodings)
    return (
        known.select(
            "bundle_id",
            "reason",
            F.when(F.col("is_text"), F.col("encoding")).otherwise("none").alias("encoding"),
            "length",
        )
        .rollup("bundle_id", "reason", "encoding")
        .agg(
            F.count("*").alias("files"),
            F.sum("length").alias("bytes"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
