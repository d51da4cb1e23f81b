"""Quality rules with line frequencies across documents.

Words are runs without ASCII white space. The base rules look at one text: ``word_chars`` counts the
code points in words, ``n_symbols`` the characters ``# * $ % & | < >``, ``n_dup_lines`` the lines with a
word that equal an earlier line, ``n_repeat_words`` the words in five-word windows that the text holds
twice or more. A text fails with fewer than 10 words, or if more than a fifth of its words repeat.

The method looks across documents. Lines are normalised (A-Z in lower case, white space collapsed,
ends trimmed) and hashed to 128 bits. For each host the documents that hold a line are counted, each distinct
text once, so copies of a page do not make its lines boilerplate. Lines above ``line_limit`` documents of
their host are removed; a text of which fewer than ``min_words`` words or less than ``min_share`` of its
words are left is depleted and rejected.

Only hashes move. First the rows that hold a line are counted, copies of a text included: counts are combined
before the shuffle, so a line that every document holds is one row per task. Only a line with more rows than
the limit can have more distinct texts, and only such lines, found again by a bitmap of their hashes and then
exactly, move with the hash of their text, to be counted once a text. Texts stay where they are.

Null and empty texts have no words and fail; a null host is a host of its own. Rows with one text and
host share one verdict, so repeated rows all appear. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import near
from sheaf.llm.arrays import NOT_SPACE, Slice, Spans, counts_by_row, grams, hashes, lines, powers, slices, span_hash, words

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 5
MIN_WORDS = 10
LINE_LIMIT = 20
MIN_SHARE = 0.2

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of items compared by all keys: which equal an earlier one, and which equal any other one."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *reversed(keys)))
    same = np.zeros(n, bool)
    if n:
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    later, any_other = np.zeros(n, bool), np.zeros(n, bool)
    later[order] = same
    any_other[order] = same | np.append(same[1:], False)
    return later, any_other


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    """The base figures of the rows of a slice."""
    spans = words(s, NOT_SPACE)
    starts_char = (s.data & 0xC0) != 0x80
    inside = NOT_SPACE[s.data]
    row = np.repeat(np.arange(s.rows), np.diff(s.offsets))
    out = {
        "n_words": counts_by_row(spans.row, s.rows),
        "word_chars": counts_by_row(row[starts_char & inside], s.rows),
        "n_symbols": counts_by_row(row[SYMBOLS[s.data]], s.rows),
    }
    piece = lines(s)
    some = np.concatenate([[0], np.cumsum(inside)])
    full = np.flatnonzero(some[piece.end] > some[piece.start])
    piece.row, piece.start, piece.end = piece.row[full], piece.start[full], piece.end[full]
    later, _ = _repeated((piece.row.astype(np.uint64), hashes(s.data, piece, 0), hashes(s.data, piece, 1)))
    out["n_dup_lines"] = counts_by_row(piece.row[later], s.rows)
    g1, at = grams(hashes(s.data, spans, 0), spans.row, WINDOW, 0)
    cover = np.zeros(len(spans.row) + 1, np.int64)
    # Most windows are unlike any other by half of the hash alone; only the rest are compared in full.
    key = g1 ^ (spans.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    twin = np.zeros(len(key), bool)
    if len(key):
        same = key[order][1:] == key[order][:-1]
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
    if twin.any():
        g2, _ = grams(hashes(s.data, spans, 1), spans.row, WINDOW, 1)
        _, shared = _repeated((spans.row[at[twin]].astype(np.uint64), g1[twin], g2[twin]))
        begin = at[twin][shared]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
    out["n_repeat_words"] = counts_by_row(spans.row[np.cumsum(cover[:-1]) > 0], s.rows)
    return out


def add_base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the base figures and the text's hash ``t1, t2`` added. They replace
    columns of their names."""
    added = [*BASE, "t1", "t2"]
    kept = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: np.zeros(batch.num_rows, np.int64) for k in added}
            for s in slices(batch.column(text_col)):
                keys = dict(zip(("t1", "t2"), (x.view(np.int64) for x in text_keys(s)), strict=True))
                for k, v in (base_counts(s) | keys).items():
                    out[k][s.first : s.first + s.rows] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(out[k]) for k in added)], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept), *(f"{k} bigint" for k in added)])
    return docs.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def line_rows(docs: DataFrame, host_col: str = "source", text_col: str = "text", only: near.Filter | None = None) -> DataFrame:
    """Per row of ``docs`` its distinct normalised lines: host, 128-bit hashes of text and line, and
    ``words``, the words in all its lines that read so. ``only`` leaves out lines whose first hash it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                t1, t2 = text_keys(s)
                s = s.lower()
                word = words(s, NOT_SPACE)
                piece = lines(s)
                first = np.searchsorted(word.start, piece.start)
                last = np.searchsorted(word.start, piece.end)
                full = last > first
                row, first, last = piece.row[full], first[full], last[full]
                l1, l2 = (_runs(hashes(s.data, word, w), first, last, w) for w in (0, 1))
                order = np.lexsort((l2, l1, row))
                row, l1, l2, n = row[order], l1[order], l2[order], (last - first)[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (l1[1:] != l1[:-1]) | (l2[1:] != l2[:-1])
                at = np.flatnonzero(new)
                total = np.add.reduceat(n, at) if len(at) else n
                if only is not None:
                    some = only(l1[at].view(np.int64))
                    at, total = at[some], total[some]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("host").take(pa.array(row[at] + s.first)),
                            *(pa.array(x.view(np.int64)) for x in (t1[row[at]], t2[row[at]], l1[at], l2[at])),
                            pa.array(total),
                        ],
                        names=["host", "t1", "t2", "l1", "l2", "words"],
                    )

    source = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kind = source.schema["host"].dataType.simpleString()
    return source.mapInArrow(run, f"host {kind}, t1 bigint, t2 bigint, l1 bigint, l2 bigint, words bigint")


def text_keys(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every text of a slice."""
    whole = Spans(np.arange(s.rows), s.offsets[:-1], s.offsets[1:])
    return hashes(s.data, whole, 0), hashes(s.data, whole, 1)


def _runs(h: np.ndarray, first: np.ndarray, last: np.ndarray, which: int) -> np.ndarray:
    """Hashes of runs of hashed words."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(which, False, len(h) + 1)[:-1], out=total[1:])
    return span_hash(total, first, last, which)


def lost_words(docs: DataFrame, host_col: str = "source", text_col: str = "text", line_limit: int = LINE_LIMIT) -> DataFrame:
    """Per host and text (``host, t1, t2``): ``lost``, the words in its lines that more than
    ``line_limit`` distinct texts of the host hold. Texts that lose nothing have no row."""
    many = line_rows(docs, host_col, text_col).groupBy("host", "l1", "l2").agg(F.count("*").alias("rows")).filter(F.col("rows") > line_limit)
    many = near.written(many.select("host", "l1", "l2"), "lines-of-many")

    def same(x: str, y: str):
        return F.col(f"{x}.host").eqNullSafe(F.col(f"{y}.host")) & (F.col(f"{x}.l1") == F.col(f"{y}.l1")) & (F.col(f"{x}.l2") == F.col(f"{y}.l2"))

    some = line_rows(docs, host_col, text_col, near.Filter(many.select(F.col("l1").alias("a"))))
    # Copies of a text fold into one row per line, largely before the shuffle.
    held = some.alias("s").join(many.alias("m"), same("s", "m"), "left_semi").groupBy("host", "l1", "l2", "t1", "t2").agg(F.first("words").alias("words"))
    held = near.written(held, "held-lines")
    frequent = held.groupBy("host", "l1", "l2").agg(F.count("*").alias("texts")).filter(F.col("texts") > line_limit)
    gone = held.alias("h").join(frequent.alias("f"), same("h", "f"))
    return gone.groupBy("h.host", "h.t1", "h.t2").agg(F.sum("h.words").alias("lost"))


def quality_report(docs: DataFrame, host_col: str = "source", line_limit: int = LINE_LIMIT, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Per document: the base figures, base_failed, kept, and lost_words."""
    source = docs.select("doc_id", F.col(host_col).alias("host"), "text")
    counted = add_base_counts(source).withColumn("base_failed", base_failed())
    lost = lost_words(docs, host_col, "text", line_limit)
    same = F.col("d.host").eqNullSafe(F.col("x.host")) & (F.col("d.t1") == F.col("x.t1")) & (F.col("d.t2") == F.col("x.t2"))
    left = F.col("n_words") - F.col("lost_words")
    return (
        counted.alias("d")
        .join(lost.alias("x"), same, "left")
        .select("doc_id", *BASE, "base_failed", F.coalesce("lost", F.lit(0)).cast("bigint").alias("lost_words"))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words")))
    )
