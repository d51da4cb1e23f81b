"""Files tables: from raw trees, from several sources, from a text table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.charsets import DEFAULT_ENCODINGS
from sheaf.functions.globs import Rule, is_closed
from sheaf.functions.sniff import SNIFF_BYTES
from sheaf.operators.classify import classify_text
from sheaf.operators.exclude import exclude_filter
from sheaf.schemas import FILES
from sheaf.session import shared_dir

# Bytes of file content a reading task hands over at a time. A worker holds such a batch several times over, and
# an executor keeps workers of earlier stages, so the batch is small.
READ_BATCH_BYTES = 2 * 1024 * 1024
# Entries of a folder handed over at a time.
LIST_ROWS = 5_000


def list_tree(spark: SparkSession, root: str, rules: Sequence[Rule] = ()) -> DataFrame:
    """Regular files below a folder all executors can reach: path (relative), length, and raw.

    Folders below which ``rules`` exclude every path are not opened; other files are listed, excluded or not.

    The tree is listed level by level, the folders of a level spread over the executors, so one
    crowded branch does not end up in one task. Every level is a written table. Folders and entries
    that cannot be read, or are gone meanwhile, are passed over; links are not followed. ``raw`` is the
    path as the file system has it; in ``path`` bytes that are no UTF-8 are U+FFFD.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(f"expected a folder: {root}")

    top = os.fsencode(root)

    def facts(entry: os.DirEntry, folder: bytes) -> tuple | None:
        try:
            is_dir = entry.is_dir(follow_symlinks=False)
            if not is_dir and not entry.is_file(follow_symlinks=False):
                return None
            size = 0 if is_dir else entry.stat(follow_symlinks=False).st_size
        except OSError:
            return None
        raw = os.path.join(folder, entry.name)
        return raw.decode("utf-8", "replace"), is_dir, size, raw

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["raw"]:
                rows = []
                try:
                    with os.scandir(os.path.join(top, folder)) as entries:
                        for entry in entries:
                            rows += filter(None, [facts(entry, folder)])
                            if len(rows) >= LIST_ROWS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except OSError:
                    pass
                yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "is_dir", "length", "raw"]
    schema = "path string, is_dir boolean, length bigint, raw binary"
    folders = spark.createDataFrame([(bytearray(b""),)], "raw binary")
    tables: list[str] = []
    while not folders.isEmpty():
        table = shared_dir(spark, "tree-level")
        folders.repartition("raw").mapInPandas(list_folders, schema).write.parquet(table)
        tables.append(table)
        folders = spark.read.schema(schema).parquet(table).filter("is_dir").filter(~is_closed(F.col("path"), rules)).select("raw")
    return spark.read.schema(schema).parquet(*tables).filter("NOT is_dir").select("path", "length", "raw")


def parts_read(root: str, column: str, limit: int) -> Callable[[pd.DataFrame], Iterator[pd.DataFrame]]:
    """What gives the rows of a listing with their bytes, in parts that end once they hold ``READ_BATCH_BYTES``."""

    def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        start, held, data = 0, 0, []
        for i, path in enumerate(batch["raw" if "raw" in batch else "path"]):
            try:
                with open(os.path.join(os.fsencode(root), os.fsencode(path)), "rb") as f:
                    data.append(f.read(limit))
            except OSError:
                data.append(None)
            held += len(data[-1] or b"")
            if held >= READ_BATCH_BYTES:
                yield batch.iloc[start : i + 1].assign(**{column: data})
                start, held, data = i + 1, 0, []
        if data:
            yield batch.iloc[start:].assign(**{column: data})

    return parts


def read_contents(
    listing: DataFrame, root: str, column: str = "content", limit: int = -1
) -> DataFrame:
    """Add the bytes of rows with ``path`` (or ``raw``, which goes before it), up to ``limit`` of each;
    null where a file is unreadable.

    The paths are spread anew first, so that files left over by a filter are read evenly.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema.fields)

    parts = parts_read(root, column, limit)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from parts(batch)

    return listing.repartition("path").mapInPandas(read, f"{fields}, {column} binary")


def sniff_tree(
    spark: SparkSession,
    root: str,
    rules: Sequence[Rule] = (),
    encodings: Sequence[str] = DEFAULT_ENCODINGS,
) -> DataFrame:
    """Files of a folder with reason and is_text, of which only the first bytes are read."""
    listing = exclude_filter(list_tree(spark, root, rules), rules)
    heads = read_contents(listing, root, "head", SNIFF_BYTES)
    return classify_text(heads, encodings).drop("head")


def scan_tree(
    spark: SparkSession, root: str, rules: Sequence[Rule] = (), bundle_id: str = "0", source_ord: int = 0
) -> DataFrame:
    """Files table of a folder. Rules apply to the listing, before any content is read."""
    listing = exclude_filter(list_tree(spark, root, rules), rules)
    return read_contents(listing, root).select(
        F.lit(bundle_id).alias("bundle_id"),
        F.lit(source_ord).alias("source_ord"),
        F.lit(False).alias("direct"),
        "path",
        "length",
        "content",
    )


def scan_sources(
    spark: SparkSession, sources: Sequence[str], rules: Sequence[Rule] = (), bundle_id: str = "0"
) -> DataFrame:
    """Files table of folders and single files in the given order.

    A single file goes by its base name and rules do not apply to it.
    """
    if not sources:
        raise ValueError("no sources")
    singles = [(i, s) for i, s in enumerate(sources) if not os.path.isdir(s)]
    tables = [
        scan_tree(spark, s, rules, bundle_id, i) for i, s in enumerate(sources) if os.path.isdir(s)
    ]
    if singles:
        given = spark.createDataFrame(singles, "source_ord int, path string")
        tables.append(
            read_contents(given, "").select(
                F.lit(bundle_id).alias("bundle_id"),
                "source_ord",
                F.lit(True).alias("direct"),
                F.element_at(F.split("path", "/"), -1).alias("path"),
                F.length("content").cast("bigint").alias("length"),
                "content",
            )
        )
    return union_sources(tables)


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """One files table from several."""
    if not tables:
        raise ValueError("no sources")
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def files_from_text(
    df: DataFrame, bundle_id: Column, path: Column, text: Column, source_ord: Column | int = 0,
    direct: Column | bool = False,
) -> DataFrame:
    """Files table over rows that hold text."""
    content = F.encode(text, "UTF-8")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        bundle_id.alias("bundle_id"),
        as_column(source_ord).cast("int").alias("source_ord"),
        as_column(direct).alias("direct"),
        path.alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stored files table."""
    return spark.read.schema(FILES).parquet(path)
