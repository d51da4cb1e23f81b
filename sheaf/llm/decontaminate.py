"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and taken as words of letters, digits and all beyond ASCII. A window is
``window`` consecutive words of a benchmark item; an item with fewer words, but not none, is one
window as a whole. Of all ``k``-word hashes a text keeps the least of every ``window - k + 1`` in a
row. Two texts that share a window choose by the same rule there, so they keep a hash in common: the
join of kept hashes misses no shared window. Around each common hash the windows that hold it are
looked up among the windows of the items, by two 64-bit hashes; words of the windows found are hit.
Items shorter than a window have no such guarantee: they are looked up at every word of a document.

The benchmark is a query set held against all documents in blocks of at most ``block_words`` words,
so what is broadcast has a bound (about 48 bytes a word). With one block the documents are not
shuffled at all; with more, what a block found is written to the shared folder before the next.

Null and empty texts have no words and are not contaminated. Repeated rows are judged one by one; an
item counts once per document, however often it occurs, and two rows of one item id are one item. A
null item id is left out of the list of items, but its words count. Other columns are not read, so
their names do not matter. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.arrays import ALNUM, SLICE_BYTES, Slice, counts_by_row, grams, hashes, slices, words
from sheaf.session import shared_dir

WINDOW = 13
GRAM = 5
BLOCK_WORDS = 1_000_000


def _word_hashes(s: Slice):
    s = s.lower()
    spans = words(s, ALNUM)
    return spans, hashes(s.data, spans, 0), hashes(s.data, spans, 1)


def winnow(h: np.ndarray, row: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept ``k``-gram hashes and the words they begin at: every one that is least in some window."""
    gram, at = grams(h, row, k)
    span = window - k + 1
    keep = np.zeros(len(gram), bool)
    n = len(gram) - span + 1
    if n > 0:
        whole = row[at[:n]] == row[at[span - 1 :]]
        least = gram[:n].copy()
        for i in range(1, span):
            np.minimum(least, gram[i : i + n], out=least)
        for i in range(span):
            keep[i : i + n] |= whole & (gram[i : i + n] == least)
    return gram[keep], at[keep]


class Index:
    """Kept hashes and windows of one block of items; items are numbers into ``ids``."""

    def __init__(self, rows: list[tuple[object, str | None]], k: int, window: int) -> None:
        self.k, self.window = k, window
        texts = pa.array([r[1] for r in rows], pa.string())
        self.ids = [r[0] for r in rows]
        kept: list[np.ndarray] = []
        tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for s in slices(texts):
            spans, h1, h2 = _word_hashes(s)
            size = counts_by_row(spans.row, s.rows)
            kept.append(winnow(h1, spans.row, k, window)[0])
            for length in {window, *size[(size > 0) & (size < window)].tolist()}:
                if length == window:
                    own = np.ones(len(spans.row), bool)
                else:
                    own = size[spans.row] == length
                g1, at = grams(h1[own], spans.row[own], length, 0)
                g2, _ = grams(h2[own], spans.row[own], length, 1)
                tables.setdefault(length, []).append((g1, g2, spans.row[own][at] + s.first))
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.tables = {}
        for length, parts in tables.items():
            g1, g2, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(g1):
                order = np.lexsort((item, g2, g1))
                g1, g2, item = g1[order], g2[order], item[order]
                first = np.ones(len(g1), bool)
                first[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
                where = np.flatnonzero(first)
                self.tables[length] = (g1[where], g2[where], np.append(where, len(g1)), item)

    def find(self, g1: np.ndarray, g2: np.ndarray, length: int) -> np.ndarray:
        """The number of the window each pair of hashes is, or -1. Pairs are unique, first hashes nearly."""
        t1, t2, _, _ = self.tables[length]
        at = np.searchsorted(t1, g1)
        out = np.full(len(g1), -1)
        step = 0
        while True:
            here = np.minimum(at + step, len(t1) - 1)
            same = (at + step < len(t1)) & (t1[here] == g1)
            if not same.any():
                return out
            hit = same & (t2[here] == g2)
            out[hit] = here[hit]
            step += 1

    def hits(self, s: Slice):
        """Of a slice: row of each word, which words are hit, and pairs of row and item."""
        spans, h1, h2 = _word_hashes(s)
        mark = np.zeros(len(h1) + 1, np.int64)
        rows, items = [], []
        for length, (_, _, where, item) in self.tables.items():
            if length == self.window:
                gram, at = winnow(h1, spans.row, self.k, self.window)
                at = at[_among(gram, self.kept)]
                begin = np.unique((at[:, None] - np.arange(self.window - self.k + 1)).ravel())
                begin = begin[(begin >= 0) & (begin + length <= len(h1))]
                begin = begin[spans.row[begin] == spans.row[begin + length - 1]]
                g1, g2 = _at(h1, begin, length, 0), _at(h2, begin, length, 1)
            else:
                g1, begin = grams(h1, spans.row, length, 0)
                near = _among(g1, self.tables[length][0])
                g1, begin = g1[near], begin[near]
                g2 = _at(h2, begin, length, 1)
            found = self.find(g1, g2, length)
            begin, found = begin[found >= 0], found[found >= 0]
            np.add.at(mark, begin, 1)
            np.add.at(mark, begin + length, -1)
            pair = np.unique(np.stack([spans.row[begin], found]), axis=1) if len(found) else np.zeros((2, 0), np.int64)
            size = where[pair[1] + 1] - where[pair[1]]
            rows.append(np.repeat(pair[0], size))
            items.append(item[np.repeat(where[pair[1]] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        empty = np.zeros(0, np.int64)
        return spans.row, np.cumsum(mark[:-1]) > 0, np.concatenate([*rows, empty]), np.concatenate([*items, empty])


def _at(h: np.ndarray, begin: np.ndarray, length: int, which: int) -> np.ndarray:
    """``grams`` at some places only."""
    every = h[begin[:, None] + np.arange(length)] if len(begin) else np.zeros((0, length), np.uint64)
    return grams(every.ravel(), np.repeat(np.arange(len(begin)), length), length, which)[0]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _ranges(hit: np.ndarray) -> np.ndarray:
    """Runs of hit words as (first, after last) pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _probe(index, text: str, earlier: bool):
    """Add ``__words, __ranges, __items``: number of words, runs of hit words and item ids so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            column = batch.column(text)
            n_words = np.zeros(len(column), np.int64)
            ranges: list[list[int]] = [[] for _ in range(len(column))]
            found: list[set[str]] = [set() for _ in range(len(column))]
            for s in slices(column, SLICE_BYTES):
                row, hit, pair_row, item = own.hits(s)
                size = counts_by_row(row, s.rows)
                n_words[s.first : s.first + s.rows] = size
                begin = np.cumsum(size) - size
                for r in np.unique(row[hit]).tolist():
                    ranges[s.first + r] = _ranges(hit[begin[r] : begin[r] + size[r]]).ravel().tolist()
                for r, i in zip(pair_row.tolist(), item.tolist(), strict=True):
                    if own.ids[i] is not None:
                        found[s.first + r].add(str(own.ids[i]))
            if earlier:
                for r, (old, ids) in enumerate(zip(batch.column("__ranges").to_pylist(), batch.column("__items").to_pylist(), strict=True)):
                    found[r].update(ids)
                    ranges[r] = _union(ranges[r], old)
            keep = [c for c in batch.schema.names if c not in ("__words", "__ranges", "__items")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array(n_words),
                    pa.array(ranges, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=[*keep, "__words", "__ranges", "__items"],
            )

    return run


def _union(a: list[int], b: list[int]) -> list[int]:
    out: list[list[int]] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [x for pair in out for x in pair]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks. Rows stream to the driver one block at a time; an item is never cut."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        n = len(row[1] or "") // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` with ``__words`` (how many), ``__ranges`` (runs of hit words: first, after
    last, ...) and ``__items`` (ids of items with an occurring window, as sorted strings)."""
    spark = docs.sparkSession
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += (", " if schema else "") + "`__words` bigint, `__ranges` array<bigint>, `__items` array<string>"
    out, pending = docs, False
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        if pending:  # the next block starts from a table, not from a chain of workers
            where = shared_dir(spark, "decontaminate")
            out.write.parquet(where)
            out = spark.read.parquet(where)
        index = spark.sparkContext.broadcast(Index(block, k, window))
        out = out.mapInArrow(_probe(index, text_col, pending), schema)
        pending = True
    return out


def hit_words(ranges: Column) -> Column:
    """How many words the runs hold."""
    steps = F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit_words(F.col("__ranges")).alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = find_contamination(docs, benchmark, **options)
    kept = found.filter(~is_contaminated(F.col("__words"), hit_words(F.col("__ranges"))))
    return kept.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
