"""Bundle tables and unpacked tables at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.paragraphs import build_paragraphs
from sheaf.schemas import PARAGRAPHS

ORDER = ["bundle_id", "source_ord", "path"]


def cluster_files(texts: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows brought together by bundle and sorted, in partitions of even size.

    ``rebalance`` lets Spark merge small partitions and split large ones by what it measures, so a
    bundle that holds a large share of the corpus is spread over many tasks. Unlike a range, it
    needs no sampling pass over the files.
    """
    return texts.hint("rebalance", "bundle_id").sortWithinPartitions(*order)


def write_bundle(texts: DataFrame, path: str) -> None:
    """Write texts as a paragraph table clustered by bundle, replacing what is there.

    Whole files are moved, not their lines, and the lines are exploded after the shuffle. Row groups
    then cover narrow ranges of bundle_id, which is what a reader prunes by; there is no folder per
    bundle, as there may be millions.
    """
    build_paragraphs(cluster_files(texts)).write.mode("overwrite").parquet(path)


def read_bundle(spark: SparkSession, path: str, bundle_ids: Sequence[str] | None = None) -> DataFrame:
    """Paragraph table, of chosen bundles if named."""
    table = spark.read.schema(PARAGRAPHS).parquet(path)
    return table if bundle_ids is None else table.filter(F.col("bundle_id").isin(list(bundle_ids)))


def write_unpacked(files: DataFrame, path: str) -> None:
    """Write unpacked files as a table clustered by bundle."""
    cluster_files(files, ["bundle_id", "path"]).write.mode("overwrite").parquet(path)
