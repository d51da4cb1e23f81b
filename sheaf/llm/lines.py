"""Fuzzy line dedup by MinHash.

A line is a piece between line feeds that is not blank; A-Z are compared in lower case and the ends are
trimmed of ASCII white space. Its set holds its ``SHINGLE``-character shingles (a shorter line is one
shingle). Signatures of ``BANDS`` bands of ``ROWS`` minima make candidates; a pair at Jaccard 0.8 shares a
band with probability 0.998, one at 0.85 with 0.9998. Candidates are verified by exact Jaccard similarity,
and union-find folds links into components, see ``near``. Of each component the first line stays, by
(doc_id, line number), nulls first, then by row content; all others go.

Equal lines are one node from the start: a task sends a signature once for lines it sees repeatedly,
and positions of equal lines are folded by an aggregate, so a line that every document holds is no
load. Documents keep their other lines in order. A document that had a line and has none left is
dropped by ``dedup_lines``; blank lines, and null, empty and blank texts, stay as they are. Of rows
that repeat doc_id and text ``dedup_lines`` keeps one, the report lists all with one verdict. An empty
table gives an empty one. The columns of documents may have any name that does not begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.arrays import NOT_SPACE, Slice, Spans, hashes, lines, mix, powers, prefix_hash, slices, span_hash
from sheaf.llm.near import Filter, near_classes, one_of_equals, split_rows, written

SHINGLE = 8
BANDS, ROWS = 9, 3
THRESHOLD = 0.8
#: Lines a task remembers so as not to send a signature again.
SEEN = 500_000
#: Bytes a slice holds, so that its arrays stay in a core's cache.
SLICE = 1 << 18
#: Shingles whose minima are taken at a time, for the same end.
STRETCH = 1 << 16
#: Lines whose sets are read at a time, and the bits of a shingle's hash beside their numbers.
READ = 1 << 10
_HASH_BITS = np.uint64(54)

_R = np.random.default_rng(21)
_TIMES = _R.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def real_lines(s: Slice) -> tuple[Spans, np.ndarray]:
    """Lines that are not blank, without white space at the ends, and their numbers in the text."""
    every = lines(s)
    first_of_row = np.searchsorted(every.row, np.arange(s.rows))
    number = np.arange(len(every.row)) - first_of_row[every.row]
    solid = np.flatnonzero(NOT_SPACE[s.data])
    lo = np.searchsorted(solid, every.start)
    hi = np.searchsorted(solid, every.end)
    full = hi > lo
    return Spans(every.row[full], solid[lo[full]], solid[hi[full] - 1] + 1), number[full]


def shingles(data: np.ndarray, spans: Spans, size: int = SHINGLE, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of spans, and where the shingles of each span begin. ``prefix`` is the
    prefix hash of the data where it is at hand."""
    prefix, inverse = prefix_hash(data, 0) if prefix is None else prefix, powers(0, True, len(data) + 1)
    if (data < 0x80).all():
        lo, hi = spans.start, spans.end
    else:
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        lo = np.searchsorted(chars, spans.start)
        hi = np.searchsorted(chars, spans.end)
        inverse = inverse[chars]
    sums = prefix if len(inverse) == len(prefix) else prefix[chars]
    count = np.maximum(hi - lo - size + 1, 1)
    begin = np.cumsum(count) - count
    h = np.zeros(int(count.sum()), np.uint64)
    if len(sums) > size:
        # Hashes of all windows lie side by side; those of a span are a stretch of them.
        window = mix((sums[size:] - sums[:-size]) * inverse[:-size])
        at = np.repeat(lo - begin, count) + np.arange(len(h))
        h = window[np.minimum(at, len(window) - 1)]
    short = np.flatnonzero(hi - lo < size)
    h[begin[short]] = span_hash(prefix, spans.start[short], spans.end[short], 0)
    return h, begin


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band hashes, one row a line."""
    if len(h) > STRETCH and len(begin) > 1:
        mid = min(max(int(np.searchsorted(begin, len(h) // 2)), 1), len(begin) - 1)
        cut = begin[mid]
        return np.concatenate([signatures(h[:cut], begin[:mid]), signatures(h[cut:], begin[mid:] - cut)])
    out = np.zeros((len(begin), BANDS), np.uint64)
    if not len(begin):
        return out
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    value = np.empty_like(low)
    for band in range(BANDS):
        total = np.full(len(begin), band + 1, np.uint64)
        for row in range(ROWS):
            np.multiply(low, _TIMES[band * ROWS + row], out=value)
            np.add(value, high, out=value)
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, begin)
        out[:, band] = mix(total)
    return out


def read_lines(contents: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sets of lines, of ``_HASH_BITS`` bits a shingle."""
    if len(contents) > READ:
        return [s for at in range(0, len(contents), READ) for s in read_lines(contents[at : at + READ])]
    ends = np.cumsum([len(x) for x in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    start = np.concatenate([[0], ends[:-1]])
    h, begin = shingles(data, Spans(np.arange(len(contents)), start, ends))
    row = np.repeat(np.arange(len(contents), dtype=np.uint64), np.diff(np.append(begin, len(h))))
    # One sort of row and hash together: the hash keeps the bits that the number of the row leaves.
    key = np.sort((row << _HASH_BITS) | (h >> (np.uint64(64) - _HASH_BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    h, row = key & ((np.uint64(1) << _HASH_BITS) - np.uint64(1)), key >> _HASH_BITS
    cuts = np.searchsorted(row, np.arange(len(contents) + 1, dtype=np.uint64))
    one = np.ones(int(np.diff(cuts).max()), np.float32)
    return [(h[lo:hi], one[: hi - lo]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc, t1, t2, n, a, b, bands``: every real line, its document (id and 128 bits of the text), its
    number and its 128 bits; bands are null where the task has sent them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch.column("text"), SLICE):
                s = s.lower()
                spans, number = real_lines(s)
                if not len(spans.row):
                    continue
                prefix = prefix_hash(s.data, 0)
                a = span_hash(prefix, spans.start, spans.end, 0).view(np.int64)
                b = hashes(s.data, spans, 1).view(np.int64)
                if len(seen) > SEEN:
                    seen.clear()
                new = np.zeros(len(a), bool)
                for i, name in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    if name not in seen:
                        seen.add(name)
                        new[i] = True
                fresh = Spans(spans.row[new], spans.start[new], spans.end[new])
                bands = signatures(*shingles(s.data, fresh, prefix=prefix)).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()), mask=pa.array(~new))
                where = pa.array(spans.row + s.first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(where) for c in ("doc", "t1", "t2")), pa.array(number), pa.array(a), pa.array(b), flat],
                    names=["doc", "t1", "t2", "n", "a", "b", "bands"],
                )

    source = _named(docs)
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(run, f"doc {kind}, t1 bigint, t2 bigint, n bigint, a bigint, b bigint, bands array<bigint>")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit("second"), F.col("text")).alias("t2"),
        "text",
    )


def line_contents(docs: DataFrame, wanted: Filter) -> DataFrame:
    """Bytes of the lines that the filter lets pass, once a task or nearly so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch.column("text"), SLICE):
                s = s.lower()
                spans, _ = real_lines(s)
                a = hashes(s.data, spans, 0).view(np.int64)
                own = np.flatnonzero(wanted(a))
                a, start, end = a[own], spans.start[own], spans.end[own]
                # The second half of the names is worked out for the bytes of these lines alone.
                stop = np.cumsum(end - start)
                data = s.data[np.repeat(end - stop, end - start) + np.arange(int((end - start).sum()))]
                b = hashes(data, Spans(spans.row[own], stop - (end - start), stop), 1).view(np.int64)
                out: list[tuple[int, int, bytes]] = []
                if len(seen) > SEEN:
                    seen.clear()
                for i, name in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    if name not in seen:
                        seen.add(name)
                        out.append((*name, s.data[start[i] : end[i]].tobytes()))
                x, y, z = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.binary())], names=["a", "b", "content"])

    return docs.select("text").mapInArrow(run, "a bigint, b bigint, content binary")


def line_verdicts(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All real lines (``doc, t1, t2, n, a, b``), and those that are equal or similar to another:
    ``doc, t1, t2, n, first``, where ``first`` is the line of their component that stays."""
    rows = written(line_rows(docs), "lines")
    near = near_classes(docs.sparkSession, rows.filter("bands is not null"), lambda wanted: line_contents(docs, wanted), read_lines, threshold)
    rows = rows.drop("bands")
    # Lines that stand alone, by far the most, take no part in the search for first lines.
    equal = rows.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    labels = equal.join(near, ["a", "b"], "full").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    named = rows.join(labels, ["a", "b"])
    place = F.struct("doc", "n", "t1", "t2")
    first = named.groupBy("la", "lb").agg(F.min(place).alias("first"))
    return rows, written(named.join(first, ["la", "lb"]).select("doc", "t1", "t2", "n", "first"), "verdicts")


def line_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per line that is not blank: doc_id, line_no, its class (doc_id and number of the line that stays),
    and whether it stays itself."""
    rows, found = line_verdicts(docs.select("doc_id", "text"), threshold)
    d, v = rows.alias("d"), found.distinct().alias("v")
    same = F.col("d.doc").eqNullSafe(F.col("v.doc")) & F.expr("d.t1 = v.t1 and d.t2 = v.t2 and d.n = v.n")
    alone = F.col("v.first").isNull()
    return d.join(v, same, "left").select(
        F.col("d.doc").alias("doc_id"),
        F.col("d.n").alias("line_no"),
        F.when(alone, F.col("d.doc")).otherwise(F.col("first.doc")).alias("class_doc_id"),
        F.when(alone, F.col("d.n")).otherwise(F.col("first.n")).alias("class_line_no"),
        (alone | F.struct("d.doc", "d.n", "d.t1", "d.t2").eqNullSafe(F.col("first"))).alias("keep"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their columns; lines that repeat another are taken out of ``text``."""
    rows, found = line_verdicts(docs.select("doc_id", "text"), threshold)
    stays = F.struct("doc", "n", "t1", "t2").eqNullSafe(F.col("first"))
    gone = found.filter(~stays).groupBy("doc", "t1", "t2").agg(F.collect_set("n").alias("__gone"))
    gone = gone.toDF("__doc", "__t1", "__t2", "__gone")
    maybe, clean = split_rows(docs, Filter(found.select(F.col("t1").alias("a"))))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.expr("__a = __t1 and __b = __t2")
    joined = maybe.join(gone.hint("shuffle_hash"), same, "left").drop("__doc", "__t1", "__t2")
    repeated = found.groupBy("doc", "t1", "t2", "n").count().filter("count > 1")
    repeated = repeated.select("doc", "t1", "t2").distinct()
    joined = one_of_equals(joined, repeated)
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i.cast("bigint")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    kept = F.col("__gone").isNull() | F.exists(left, lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    changed = joined.filter(kept).withColumn("text", text).select(*names)
    return clean.select(*names).unionByName(changed)
