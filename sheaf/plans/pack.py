"""Files to paragraphs, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.charsets import DEFAULT_ENCODINGS
from sheaf.functions.globs import Rule, default_rules
from sheaf.functions.sniff import sniff_prefix
from sheaf.operators.classify import classify_text, decode_text
from sheaf.operators.duplicates import duplicate_paths, first_duplicate
from sheaf.operators.exclude import exclude_filter
from sheaf.operators.paragraphs import build_paragraphs
from sheaf.operators.summary import bundle_table
from sheaf.session import shared_dir
from sheaf.sources.files import read_contents, sniff_tree, union_sources


# Failed bundles that may be broadcast; beyond, the join shuffles.
BROADCAST_BUNDLES = 100_000


class Packed(NamedTuple):
    texts: DataFrame
    paragraphs: DataFrame
    bundles: DataFrame


def pack(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    encodings: Sequence[str] = DEFAULT_ENCODINGS,
    detect_wide: bool = False,
) -> Packed:
    """Pack every bundle of a files table; without rules the built-in ones apply.

    All steps up to the paragraphs look at one file at a time, so nothing is shuffled.
    """
    kept = exclude_filter(files, default_rules() if rules is None else rules)
    classified = classify_text(kept, encodings)
    texts = decode_text(classified.filter("is_text"), encodings, detect_wide)
    return Packed(texts, build_paragraphs(texts), bundle_table(classified))


def pack_once(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    encodings: Sequence[str] = DEFAULT_ENCODINGS,
    detect_wide: bool = False,
) -> Packed:
    """``pack`` and ``pack_sources`` over one table in the shared folder, for whoever needs several of the results.

    Every file is read, sniffed and decoded once; texts, paragraphs, counts and repeated paths follow from what was
    written. A bundle in which two sources bring a text file of one path fails. Repeats are looked for among names, so
    no text moves for them. The table holds each text once and no bytes of binaries.
    """
    spark = files.sparkSession
    kept = exclude_filter(files, default_rules() if rules is None else rules)
    classified = classify_text(kept, encodings).withColumn("content", F.when(F.col("is_text"), F.col("content")))
    known = decode_text(classified, encodings, detect_wide)
    where = shared_dir(spark, "packed")
    known.withColumn("text", F.when(F.col("is_text"), F.col("text"))).write.parquet(where)
    staged = spark.read.schema(known.schema).parquet(where)
    failed = first_duplicate(staged.filter("is_text"))
    failed = failed.selectExpr("bundle_id", "concat('duplicate path: ', path) AS error")
    where = shared_dir(spark, "failed")
    failed.write.parquet(where)
    failed = spark.read.schema(failed.schema).parquet(where)
    if failed.limit(BROADCAST_BUNDLES + 1).count() <= BROADCAST_BUNDLES:
        failed = F.broadcast(failed)
    texts = staged.filter("is_text").join(failed, "bundle_id", "left_anti")
    return Packed(texts, build_paragraphs(texts), bundle_table(staged, errors=failed))


def pack_tree(
    spark: SparkSession,
    root: str,
    rules: Sequence[Rule] | None = None,
    encodings: Sequence[str] = DEFAULT_ENCODINGS,
    bundle_id: str = "0",
) -> Packed:
    """Pack a folder. Excluded files are not opened, and binaries are read no further than sniffed."""
    known = sniff_tree(spark, root, default_rules() if rules is None else rules, encodings)
    known = known.select(
        F.lit(bundle_id).alias("bundle_id"), F.lit(0).alias("source_ord"), *known.columns
    )
    texts = decode_text(read_contents(known.filter("is_text"), root), encodings)
    return Packed(texts, build_paragraphs(texts), bundle_table(known))


def pack_sources(
    sources: Sequence[DataFrame],
    rules: Sequence[Rule] | None = None,
    encodings: Sequence[str] = DEFAULT_ENCODINGS,
) -> Packed:
    """Pack several files tables into the same bundles; a path met twice fails its bundle.

    Repeats are looked for on names first. Only files with a repeated name are then classified, as a
    repeat counts between text files only; without any, Spark drops that branch when it runs.
    """
    kept = exclude_filter(union_sources(sources), default_rules() if rules is None else rules)
    repeated = duplicate_paths(kept.drop("content")).select("bundle_id", "path")
    # Sniffing needs the beginning only, so no more of a suspect moves.
    heads = kept.withColumn("content", sniff_prefix(F.col("content")))
    suspects = heads.join(repeated, ["bundle_id", "path"], "left_semi")
    failed = first_duplicate(classify_text(suspects, encodings), F.col("is_text"))
    failed = failed.selectExpr("bundle_id", "concat('duplicate path: ', path) AS error")
    classified = classify_text(kept, encodings)
    # Bundles that fail are few as a rule: below a checked number they are sent to the files.
    if failed.limit(BROADCAST_BUNDLES + 1).count() <= BROADCAST_BUNDLES:
        failed = F.broadcast(failed)
    good = classified.filter("is_text").join(failed, "bundle_id", "left_anti")
    texts = decode_text(good, encodings)
    return Packed(texts, build_paragraphs(texts), bundle_table(classified.drop("content"), errors=failed))
