"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A text is the weighted set of its five-word shingles: words are runs without ASCII white space, A-Z in
lower case; a text with fewer words, but not none, is one shingle. The weight of a shingle is its count
in the text times its inverse document frequency. ICWS draws ``BANDS * ROWS`` samples a text, so that two
texts agree in each with the probability of their weighted Jaccard similarity; ``ROWS`` samples make a band.
A pair at 0.8 shares a band with probability 0.9996. Candidates are verified by weighted Jaccard similarity
on whole sets and folded into classes, see ``near``.

Document frequencies are those of all documents, counted in ``CELLS`` cells by the shingle's hash: what is
broadcast has a fixed size (2 MB), and shingles that share a cell share its count. A count is thus at
least the true one; a shingle that a great part of the corpus holds still stands out from the rest.

Equal texts are one class from the start and one node of the search. Texts without words (null, empty,
blank) are similar to nothing, each is a class of its own. A class is named by its least doc_id (nulls
first). Of rows that repeat doc_id and text ``drop_near_duplicates`` keeps one; the report lists all,
with one verdict. Other columns are not read; their names must not begin with ``__``. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.arrays import NOT_SPACE, Slice, counts_by_row, grams, hashes, mix, slices, words
from sheaf.llm.near import Filter, near_classes, one_of_equals, split_rows, written

WORDS = 5
BANDS, ROWS = 20, 5
THRESHOLD = 0.8
CELLS = 1 << 18
SEEN = 200_000

_R = np.random.default_rng(31)
_TIMES = _R.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, at the middle of 65,536 equal steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(p), 1.5)
    for _ in range(60):  # Newton's steps for 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


_GAMMA = _gamma_table()
_RATE = _GAMMA.astype(np.float32)
_RATE_INVERSE = (1 / _GAMMA).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA).astype(np.float32)


def shingle_sets(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a slice: row, shingle hash and count in the row, sorted by row and hash."""
    s = s.lower()
    spans = words(s, NOT_SPACE)
    h = hashes(s.data, spans, 0)
    gram, at = grams(h, spans.row, WORDS)
    row = spans.row[at]
    size = counts_by_row(spans.row, s.rows)
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        begin = (np.cumsum(size) - size)[short]
        whole = np.zeros(len(short), np.uint64)
        for i in range(WORDS - 1):
            more = size[short] > i
            whole[more] = mix(whole[more] + h[begin[more] + i] + np.uint64(i + 1))
        row, gram = np.concatenate([row, short]), np.concatenate([gram, whole])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(new)
    return row[at], gram[at], np.diff(np.append(at, len(row)))


def cell(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every cell: 1 + ln((N + 1) / (n + 1)), at least 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for s in slices(batch.column("text")):
                held += np.bincount(cell(shingle_sets(s)[1]), minlength=CELLS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], n))], names=["cell", "n"])

    counts = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # CELLS + 1 rows at most
    at, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    held = np.zeros(CELLS, np.int64)
    held[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    return (1 + np.maximum(np.log((total + 1) / (held + 1)), 0)).astype(np.float32)


def samples(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the rows that have shingles, and which rows these are."""
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros((len(begin), BANDS), np.uint64)
    if not len(begin):
        return out, begin
    log_weight = np.log(weight).astype(np.float32)
    for band in range(BANDS):
        total = np.full(len(begin), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            x = gram * _TIMES[k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            rate = (x >> np.uint64(48)).astype(np.intp)
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_weight * _RATE_INVERSE[rate] + beta)
            value = _LOG_GAMMA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)] - _RATE[rate] * (t - beta + 1)
            # The least value wins; its shingle and t ride along as the lower half of the number.
            order = (np.float32(256) + value).view(np.uint32).astype(np.uint64) << np.uint64(32)
            own = (gram ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
            total = total * np.uint64(0x9E3779B97F4A7C15) + (np.minimum.reduceat(order | own, begin) & np.uint64(0xFFFFFFFF))
        out[:, band] = mix(total)
    return out, row[begin]


def pack_set(gram: np.ndarray, weight: np.ndarray) -> bytes:
    return gram.astype("<u8").tobytes() + weight.astype("<f4").tobytes()


def read_sets(contents: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(x, "<u8", len(x) // 12), np.frombuffer(x, "<f4", len(x) // 12, len(x) // 12 * 8)) for x in contents]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), F.col("text")).alias("b"), "text")


def signature_rows(docs: DataFrame, idf) -> DataFrame:
    """``doc_id, a, b, has_words, bands``: bands are null where the task has sent them for an equal text."""
    source = _named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            names = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            new = np.zeros(batch.num_rows, bool)
            if len(seen) > SEEN:
                seen.clear()
            for i, name in enumerate(names):
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            some = np.zeros(batch.num_rows, bool)
            bands: list[np.ndarray | None] = [None] * batch.num_rows
            texts = batch.column("text")
            for s in slices(texts):
                part = _only(s, new[s.first : s.first + s.rows])
                row, gram, count = shingle_sets(part)
                band, who = samples(row, gram, count * table[cell(gram)], part.rows)
                band = band.view(np.int64)
                for r, values in zip(who.tolist(), band, strict=True):
                    bands[s.first + r] = values
                some[s.first : s.first + s.rows] = counts_by_row(words(s, NOT_SPACE).row, s.rows) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("a"), batch.column("b"), pa.array(some), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "a", "b", "has_words", "bands"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, a bigint, b bigint, has_words boolean, bands array<bigint>")


def _only(s: Slice, keep: np.ndarray) -> Slice:
    """The slice with the other rows empty."""
    if keep.all():
        return s
    size = np.diff(s.offsets)
    return Slice(s.first, s.rows, s.data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(np.where(keep, size, 0))]))


def set_rows(docs: DataFrame, idf, wanted: Filter) -> DataFrame:
    """Weighted sets of the texts that the filter lets pass, once a task or nearly so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            if len(seen) > SEEN:
                seen.clear()
            new = wanted(a)
            for i in np.flatnonzero(new).tolist():
                name = (int(a[i]), int(b[i]))
                new[i] = name not in seen
                seen.add(name)
            for s in slices(batch.column("text")):
                row, gram, count = shingle_sets(_only(s, new[s.first : s.first + s.rows]))
                weight = count * table[cell(gram)]
                edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, int)
                who = row[edge[:-1]] + s.first
                sets = [pack_set(gram[lo:hi], weight[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a[who]), pa.array(b[who]), pa.array(sets, pa.binary())], names=["a", "b", "content"])

    return _named(docs).select("a", "b", "text").mapInArrow(run, "a bigint, b bigint, content binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All rows (``doc_id, a, b, has_words``), and those equal or similar to another: ``doc_id, a, b,
    first, members``, where ``first`` is the row of their class that stays."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs))
    rows = written(signature_rows(docs, idf), "signatures")
    near = near_classes(spark, rows.filter("bands is not null"), lambda wanted: set_rows(docs, idf, wanted), read_sets, threshold)
    rows = rows.drop("bands")
    full = rows.filter("has_words")
    equal = full.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    labels = equal.join(near, ["a", "b"], "full").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    named = full.join(labels, ["a", "b"])
    first = named.groupBy("la", "lb").agg(F.min(F.struct("doc_id", "a", "b")).alias("first"), F.count("*").alias("members"))
    return rows, written(named.join(first, ["la", "lb"]).select("doc_id", "a", "b", "first", "members"), "verdicts")


def class_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document its class, named by the least doc_id in it, how many rows the class has, and
    whether the row is the one that stays."""
    rows, found = near_duplicates(docs.select("doc_id", "text"), threshold)
    d, v = rows.alias("d"), found.distinct().alias("v")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & F.expr("d.a = v.a and d.b = v.b")
    alone = F.col("v.first").isNull()
    return d.join(v, same, "left").select(
        "d.doc_id",
        F.when(alone, F.col("d.doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("members", F.lit(1)).cast("bigint").alias("members"),
        (alone | F.struct("d.doc_id", "d.a", "d.b").eqNullSafe(F.col("first"))).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their columns, one of each class."""
    _, found = near_duplicates(docs.select("doc_id", "text"), threshold)
    stays = F.struct("doc_id", "a", "b").eqNullSafe(F.col("first"))
    found = found.select(F.col("doc_id").alias("doc"), "a", "b", stays.alias("stays"))
    extra = found.filter(~F.col("stays")).select("doc", "a", "b").distinct().toDF("__doc", "__t1", "__t2")
    maybe, clean = split_rows(docs, Filter(found))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.expr("__a = __t1 and __b = __t2")
    left = maybe.join(extra.hint("shuffle_hash"), same, "left_anti")
    repeated = found.filter("stays").groupBy("doc", "a", "b").count().filter("count > 1").select("doc", "a", "b")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return clean.select(*names).unionByName(one_of_equals(left, repeated).select(*names))
