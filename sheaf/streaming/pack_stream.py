"""Arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf.functions.charsets import DEFAULT_ENCODINGS
from sheaf.functions.globs import Rule
from sheaf.plans.pack import pack
from sheaf.session import shared_dir


def pack_arrivals(
    files: DataFrame, rules: Sequence[Rule] | None = None, encodings: Sequence[str] = DEFAULT_ENCODINGS
) -> DataFrame:
    """Paragraphs of a stream of files: the batch plan, which keeps no state."""
    return pack(files, rules, encodings).paragraphs


def guard_duplicates(files: DataFrame, event_time: str, delay: str) -> DataFrame:
    """First file of each (bundle_id, path) within ``delay``, the time for which state is kept."""
    return files.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["bundle_id", "path"])


def start_append(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet table; by default until all that has arrived is done."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(table)
    )


def drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what has arrived and read back the table it wrote."""
    table, checkpoint = shared_dir(spark, label), shared_dir(spark, f"{label}-state")
    start_append(stream, table, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)
