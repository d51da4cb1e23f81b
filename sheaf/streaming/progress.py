"""Counts taken while a plan runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheaf.functions.globs import Rule, is_excluded
from sheaf.operators.classify import classify_text


def observe_pack(
    files: DataFrame,
    rules: Sequence[Rule],
    encodings: Sequence[str],
    seen: Observation | str,
    sniffed: Observation | str,
) -> DataFrame:
    """Classified files that report, as they pass, how many were seen and excluded, kept and skipped.

    The counts ride along with the job, so no second pass is made. A streaming query takes names
    instead of observations and shows the counts in its progress.
    """
    marked = files.withColumn("excluded", ~F.col("direct") & is_excluded(F.col("path"), rules))
    marked = marked.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if("excluded").alias("excluded")
    )
    classified = classify_text(marked.filter(~F.col("excluded")).drop("excluded"), encodings)
    return classified.observe(
        sniffed,
        F.count_if("is_text").alias("kept"),
        F.count_if(~F.col("is_text")).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("is_text"), F.col("length"))), F.lit(0)).alias("kept_bytes"),
    )
