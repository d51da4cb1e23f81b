"""Cut a paragraph stream at its headings and fold every segment back into a file.

A stream has a bundle, a position ``seq`` that is unique within it, a style and a text. One bundle may
hold a large share of all rows, so no window here runs over a whole bundle. Rows without their text are
ranked first (``ranks``), which cuts the stream into blocks of bounded size and says what every part of a file
belongs to; rows with text then go to their block once, and windows stay within blocks. Positions may have
gaps of any width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import file_identity, validate_heading
from sheaf.functions.text import trim_line_feeds
from sheaf.operators.paragraphs import is_heading
from sheaf.operators.ranks import Ranked, rank_rows

# Rows and bytes per part of a file.
PART_SPAN = 1 << 17
PART_BYTES = 64 * 1024 * 1024


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "is_heading": is_heading(F.col("style")),
            "has_text": trim_line_feeds(F.coalesce("text", F.lit(""))) != "",
        }
    )


def rank_stream(stream: DataFrame, span: int = PART_SPAN) -> Ranked:
    """Rank the rows of a stream by bundle and position; text is read, but only that of headings is moved."""
    heading = F.when(F.col("is_heading"), F.coalesce("text", F.lit("")))
    return rank_rows(_flagged(stream).select("bundle_id", "seq", "is_heading", "has_text", heading.alias("heading")), span)


def _marked(stream: DataFrame, ranked: Ranked, marks: DataFrame) -> DataFrame:
    """Rows of ``stream`` in blocks, with the last of ``marks`` (bundle_id, seq, mark) at or before each, in its block.

    ``at`` counts rows since that mark. Marks travel with the rows and are handed on by a window, so rows move
    once and meet no join; a block holds every mark its rows need, as blocks begin with one.
    """
    carried = marks.select("bundle_id", "seq", F.struct("mark").alias("own"))
    rows = _flagged(stream).withColumn("is_row", F.lit(True))
    both = rows.unionByName(carried, allowMissingColumns=True)
    both = both.withColumn("block", ranked.block(F.col("bundle_id"), F.col("seq")))
    # a mark comes before the row at its position
    upto = Window.partitionBy("block", "bundle_id").orderBy("seq", F.col("is_row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("before", F.count("is_row").over(upto))
    last = F.last(F.when(F.col("own").isNotNull(), F.struct("own.mark", "before")), ignorenulls=True).over(upto)
    return (
        counted.withColumn("last", last)
        .filter("is_row")
        .withColumns({"mark": F.col("last.mark"), "at": F.col("before") - F.col("last.before") - 1})
        .drop("last", "before", "own", "is_row")
    )


def segment_by_heading(stream: DataFrame, ranked: Ranked | None = None) -> DataFrame:
    """Add seg_no (0 before the first heading), seg_seq (position of the heading) and seg_at (rows since it).

    Also is_heading, and has_text for rows with more than line feeds.
    """
    ranked = ranked or rank_stream(stream)
    marks = ranked.rows.filter("first").select("bundle_id", "seq", F.struct("seg_no", "seg_seq", "at").alias("mark"))
    return (
        _marked(stream, ranked, marks)
        .withColumns({"seg_no": F.col("mark.seg_no"), "seg_seq": F.col("mark.seg_seq"), "seg_at": F.col("mark.at") + F.col("at")})
        .drop("block", "mark", "at")
    )


def drop_preamble(segmented: DataFrame) -> DataFrame:
    return segmented.filter("seg_no > 0")


def _fold(
    rows: DataFrame,
    key: Sequence[str],
    order: str,
    offset: Column,
    span: int,
    part_bytes: int,
    files: DataFrame | None = None,
) -> DataFrame:
    """One row per file and part: key, part_no, heading, content, and what ``files`` carries.

    ``key`` tells a file, ``offset`` how far a row is from its heading. ``files`` (key, heading, more
    columns) says which files are wanted; without it all are. What is known of a file is joined to
    its rows per block of ``span`` offsets, and the fold works inside these blocks, so text is moved
    once and a file of any length is spread over its blocks.
    """
    rows = rows.withColumn("offset", offset).withColumn("block", F.floor(F.col("offset") / span))
    if files is None:
        files = rows.filter("is_heading").select(*key, F.coalesce("text", F.lit("")).alias("heading"))
    # The flags were set where rows were read: no text is in these facts. Blocks are those that rows are in.
    last_text = F.coalesce(F.max(F.when(F.col("has_text") & ~F.col("is_heading"), F.col("offset"))), F.lit(0))
    blocks = rows.groupBy(*key, "block").agg(last_text.alias("last_text"))
    facts = blocks.groupBy(*key).agg(F.max("last_text").alias("last_text"))
    carried = [c for c in files.columns if c not in key]
    wanted = files.join(facts, list(key)).join(blocks.select(*key, "block"), list(key))
    text = F.coalesce("text", F.lit(""))
    place = [*key, "block"]
    before = Window.partitionBy(*place).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    body = F.when(~F.col("is_heading"), F.struct(order, text.alias("text")))
    lines = F.transform(F.array_sort(F.collect_list(body)), lambda r: r["text"])
    # Rows of nothing but line feeds at the end of a file are not part of it.
    joined = rows.withColumn("bytes", F.octet_length(text) + 1).join(wanted, place).filter("offset <= last_text")
    joined = joined.withColumn("run", F.floor(size / part_bytes))
    folded = joined.groupBy(*place, "run").agg(
        F.min("offset").cast("bigint").alias("part_no"),
        *(F.first(c).alias(c) for c in carried),
        F.array_join(lines, "\n").alias("content"),
        (F.max("offset") == F.max("last_text")).alias("is_last"),
        # A heading makes a part by itself only if nothing follows it.
        ((F.count(body) > 0) | (F.max("last_text") == 0)).alias("is_part"),
    ).filter("is_part")
    content = F.when(F.col("is_last"), trim_line_feeds(F.col("content"))).otherwise(F.col("content"))
    return folded.select(*key, "part_no", *carried, content.alias("content"))


def fold_content(
    segmented: DataFrame, span: int = PART_SPAN, part_bytes: int = PART_BYTES, files: DataFrame | None = None
) -> DataFrame:
    """Segments as files: bundle_id, seg_no, seg_seq, part_no, heading, content.

    Body rows are joined with LF and the LFs at the end go; a heading alone gives empty content. A
    file is its parts joined with LF in the order of part_no, the rows between a part's first row and
    the heading (0 for the first part). Parts end at ``span`` rows or ``part_bytes`` bytes, so most
    files have one, and no group or cell is larger than that.
    """
    key = ["bundle_id", "seg_no", "seg_seq"] if files is None else ["bundle_id", "seg_seq"]
    return _fold(drop_preamble(segmented), key, "seq", F.col("seg_at"), span, part_bytes, files)


def fold_stream(stream: DataFrame, ranked: Ranked, files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """:func:`fold_content` straight from a stream, for the ``files`` (bundle_id, seg_seq, more columns) that are wanted.

    The marks where parts begin carry what is known of their file, so the text is moved once, to its block, and
    cut and folded there. Parts end every ``span`` rows of :func:`rank_stream`, or at ``part_bytes`` bytes.
    """
    key = ["bundle_id", "seg_seq"]
    carried = [c for c in files.columns if c not in key]
    body_row = F.col("has_text") & ~F.col("is_heading")
    facts = ranked.rows.filter("seg_no > 0").groupBy(*key).agg(
        F.max("seg_no").alias("seg_no"), F.coalesce(F.max(F.when(body_row, F.col("seq"))), F.col("seg_seq")).alias("last_seq")
    )
    known = ranked.rows.filter("first").select("bundle_id", "seq", "seg_seq", "at").join(files.join(facts, key), key, "left")
    # A file that is not wanted keeps its mark, with nothing in it, so its rows do not go to the file before.
    info = F.when(F.col("last_seq").isNotNull(), F.struct("seg_seq", "at", "last_seq", "seg_no", *carried))
    rows = _marked(stream, ranked, known.select("bundle_id", "seq", info.alias("mark")))
    rows = rows.filter(F.col("mark").isNotNull() & (F.col("seq") <= F.col("mark.last_seq")))
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(
        "block", "bundle_id", "seq", "is_heading", "mark", F.col("mark.seg_seq").alias("seg_seq"), F.col("mark.at").alias("part"),
        (F.col("mark.at") + F.col("at")).alias("at"), text.alias("text"), (F.octet_length(text) + 1).alias("bytes"),
    )
    place = ["block", "bundle_id", "seg_seq", "part"]
    before = Window.partitionBy(*place).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / part_bytes)
    body = F.when(~F.col("is_heading"), F.struct("seq", "text"))
    lines = F.transform(F.array_sort(F.collect_list(body)), lambda r: r["text"])
    folded = (
        rows.withColumn("run", run)
        .groupBy(*place, "run")
        .agg(
            F.min("at").alias("part_no"),
            F.first("mark").alias("mark"),
            F.array_join(lines, "\n").alias("content"),
            F.max("seq").alias("last"),
            F.count(body).alias("lines"),
        )
        # A heading makes a part by itself only if nothing follows it.
        .filter((F.col("lines") > 0) | (F.col("mark.last_seq") == F.col("seg_seq")))
    )
    content = F.when(F.col("last") == F.col("mark.last_seq"), trim_line_feeds(F.col("content"))).otherwise(F.col("content"))
    return folded.select("bundle_id", "seg_seq", "mark.seg_no", "part_no", *(F.col("mark")[c].alias(c) for c in carried), content.alias("content"))


def fold_files(
    paragraphs: DataFrame, span: int = PART_SPAN, part_bytes: int = PART_BYTES, files: DataFrame | None = None
) -> DataFrame:
    """:func:`fold_content` for paragraph tables, whose rows name their file: nothing to segment."""
    key = ["bundle_id", "source_ord", "path"]
    rows = _flagged(paragraphs).withColumn("is_heading", F.col("line_no") == 0)
    return _fold(rows, key, "line_no", F.col("line_no"), span, part_bytes, files)


def drop_empty_heading(folded: DataFrame) -> DataFrame:
    """A heading without text yields no file and takes its body with it."""
    return folded.filter(F.col("heading") != "")


def validate_headings(files: DataFrame) -> DataFrame:
    checked = validate_heading(F.col("heading"))
    return files.withColumn("checked", checked).select("*", F.col("checked.path").alias("path_"), "checked.error").drop(
        "checked", *(["path"] if "path" in files.columns else [])
    ).withColumnRenamed("path_", "path")


def ranked_files(ranked: Ranked) -> DataFrame:
    """:func:`heading_files` of a stream that is ranked already."""
    return validate_headings(drop_empty_heading(ranked.rows.filter("is_heading").select("bundle_id", F.col("seq").alias("seg_seq"), "heading")))


def heading_files(stream: DataFrame) -> DataFrame:
    """Every heading of a stream as (bundle_id, seg_seq, path, error), from heading rows only."""
    heads = stream.filter(is_heading(F.col("style"))).select(
        "bundle_id", F.col("seq").alias("seg_seq"), F.coalesce("text", F.lit("")).alias("heading")
    )
    return validate_headings(drop_empty_heading(heads))


def stop_at_first_error(
    files: DataFrame, decided_on: DataFrame | None = None, order: str = "seg_seq"
) -> DataFrame:
    """Keep the files of a bundle before its first bad path.

    One number per bundle that has a bad path is found by an aggregate (over ``decided_on``, which
    may hold the names without the content) and joined back; the join, not a window, meets the large
    bundles, and a skewed side can be split.
    """
    named = files if decided_on is None else decided_on
    first = (
        named.filter("error IS NOT NULL").groupBy("bundle_id").agg(F.min(order).alias("first_bad"))
    )
    return (
        files.join(first, "bundle_id", "left")
        .filter(F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad")))
        .drop("first_bad")
    )


def superseded(files: DataFrame, order: str = "seg_seq") -> DataFrame:
    """(bundle_id, order) of files that a later file with the same path replaces."""
    named = files.select("bundle_id", order, file_identity(F.col("path")).alias("identity"))
    last = (
        named.groupBy("bundle_id", "identity")
        .agg(F.max(order).alias("last"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    return (
        named.join(last, ["bundle_id", "identity"])
        .filter(F.col(order) < F.col("last"))
        .select("bundle_id", order)
    )


def last_write_wins(
    files: DataFrame, decided_on: DataFrame | None = None, order: str = "seg_seq"
) -> DataFrame:
    """Of files with one path keep the last.

    The losers are found on names alone (``decided_on`` may give them without their content) and
    taken out with an anti-join on a unique key, so a path that repeats endlessly gathers nowhere.
    """
    losers = superseded(files if decided_on is None else decided_on, order)
    return files.join(losers, ["bundle_id", order], "left_anti")


def unpack_summary(files: DataFrame) -> DataFrame:
    """Files written per bundle, and over all bundles (bundle_id null)."""
    return files.rollup("bundle_id").agg(F.count("*").alias("file_count"))


def stop_at_first_bad_bundle(files: DataFrame, order: str = "seg_seq") -> DataFrame:
    """Bundles go in the order of ``bundle_ord``; the first with a bad path is the last touched."""
    bad = files.filter("error IS NOT NULL").agg(F.min("bundle_ord").alias("o")).scalar()
    in_time = files.filter(bad.isNull() | (F.col("bundle_ord") <= bad))
    return stop_at_first_error(in_time, order=order)
