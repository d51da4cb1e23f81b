"""Periodic runs of words, found by descending-LCP Kruskal.

Words are runs without ASCII white space. A run is a stretch with smallest period ``q`` (words ``q`` apart
are identical) of at least ``max(min_length, exponent * q)`` words that no neighbouring word extends.

Per text the suffixes are put in order by prefix doubling, neighbours get the length of their longest
common prefix (LCP), and those neighbours are edges. Edges are taken from the longest LCP down; each
unites two classes of suffixes. A class keeps the ordered set of its positions, the smaller set moves into
the larger one. When positions ``i < j`` become neighbours in the united set, their LCP is the level just
reached, and no suffix between them shares as much. So with ``d = j - i`` at most that level, the text has
period ``d`` from ``i`` over ``level + d`` words, and ``d`` is the smallest one: a smaller period would have put
another position of the class between the two. If the word before ``i`` does not go on with the period, that
stretch is a run; else the run was met at a higher level. Every run is met once, at its first word.

Levels end where no run can be: a run of ``length`` words has an LCP of ``length - q`` at its first word, which is
at least ``min_length - min_length // exponent``. Texts that repeat no stretch of so many words have no run and
are put aside by hashes of such stretches before anything is sorted.

Everything happens within one text, nothing is shuffled. Words are compared by 128 bits of hash. Memory
is about 4 bytes a word for every doubling, so 4 * log2 of the longest repeat, and only for texts with one.

Null and empty texts have no words and no runs. Rows are independent, so repeated rows have equal results.
Of two runs that overlap each is found. Other columns stay; ``n_words``, ``runs`` and ``collapsed`` replace columns
of their names. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.binding import let
from sheaf.llm.arrays import NOT_SPACE, Slice, Spans, counts_by_row, grams, hashes, mix, words
from sheaf.llm.tables import add_by_text

MIN_LENGTH = 24
EXPONENT = 3

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
ADDED = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("runs", T.ArrayType(RUN, False), False),
    T.StructField("collapsed", T.StringType(), False),
]


def suffix_order(word: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all rows in order, and per doubling ``j`` the rank of every position by its first ``2**j``
    words. Ranks are equal exactly where these words are, within a row; ``end`` is the end of each one's row."""
    n = len(word)
    kind = np.int32 if n < 1 << 31 else np.int64
    key = row.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(first)
    rank = np.empty(n, kind)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    levels, width = [rank], 1
    twin = ~first
    twin[:-1] |= ~first[1:]
    active = order[twin]  # positions whose rank another one shares, by rank
    while len(active):
        ahead = active + width
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        old = rank[active].astype(np.int64)
        key = old * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, old, key = active[by], old[by], key[by]
        new_group, new_part = np.ones(len(by), bool), np.ones(len(by), bool)
        new_group[1:] = old[1:] != old[:-1]
        new_part[1:] = key[1:] != key[:-1]
        at = np.arange(len(by))
        group = np.maximum.accumulate(np.where(new_group, at, 0))
        part = np.maximum.accumulate(np.where(new_part, at, 0))
        order[old + at - group] = active
        rank = rank.copy()
        rank[active] = old + part - group
        levels.append(rank)
        width *= 2
        twin = ~new_part
        twin[:-1] |= ~new_part[1:]
        active = active[twin]
    return order, levels


def shared_prefixes(a: np.ndarray, b: np.ndarray, end: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The LCP of the suffixes at ``a`` and at ``b``, which are of one row each."""
    out = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        within = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = within[levels[j][x[within]] == levels[j][y[within]]]
        out[same] += 1 << j
    return out


def descend(order: np.ndarray, lcp: np.ndarray, edges: np.ndarray, word: np.ndarray, begin: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """Unite suffix classes along ``edges`` (places in ``order`` that join the place before) by falling LCP.

    ``begin`` is where the row of a position starts. Gives (first position, length, period) of every run.
    """
    found: list[tuple[int, int, int]] = []
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent[top]) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def meet(i: int, j: int, level: int) -> None:
        d = j - i
        if (exponent - 1) * d <= level and level + d >= min_length and (i == begin[i] or word[i - 1] != word[j - 1]):
            found.append((i, level + d, d))

    falling = edges[np.argsort(-lcp[edges], kind="stable")]
    levels = lcp[falling].tolist()
    left, right = order[falling - 1].tolist(), order[falling].tolist()
    for i, j, level in zip(left, right, levels, strict=True):
        for x in (i, j):
            if x not in parent:
                parent[x] = x
                members[x] = [x]
        a, b = root(i), root(j)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members.pop(b)
        parent[b] = a
        places = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, at) in enumerate(zip(small, places, strict=True)):
            # positions that fall into one gap of the larger set are neighbours already
            if at and (k == 0 or places[k - 1] != at):
                meet(large[at - 1], p, level)
            if at < len(large) and (k == last or places[k + 1] != at):
                meet(p, large[at], level)
        if last < 8:
            for p, at in zip(reversed(small), reversed(places), strict=True):
                large.insert(at, p)
        else:
            large.extend(small)
            large.sort()  # two ordered stretches: merged, not sorted anew
    return found


def runs_of(s: Slice, spans: Spans, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Runs of the rows of a slice: columns row, start (word of the row), length, period, in that order."""
    least = min_length - min_length // exponent
    nothing = np.zeros((0, 4), np.int64)
    h = hashes(s.data, spans, 0)
    gram, at = grams(h, spans.row, least)
    if not len(gram):
        return nothing
    gram = mix(gram + spans.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(gram, kind="stable")
    again = by[1:][gram[by][1:] == gram[by][:-1]]
    repeats = np.zeros(s.rows, bool)
    repeats[spans.row[at[again]]] = True
    own = np.flatnonzero(repeats[spans.row])
    if not len(own):
        return nothing
    row, h1 = spans.row[own], h[own]
    h2 = hashes(s.data, spans, 1)[own]
    by = np.lexsort((h2, h1))
    new = np.zeros(len(by), bool)
    new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    word = np.empty(len(by), np.int64)
    word[by] = np.cumsum(new)
    begin, end = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
    order, levels = suffix_order(word, row, end)
    coarse = least.bit_length() - 1
    if len(levels) <= coarse:
        return nothing
    near = 1 + np.flatnonzero(levels[coarse][order[1:]] == levels[coarse][order[:-1]])
    lcp = np.zeros(len(order), np.int64)
    lcp[near] = shared_prefixes(order[near - 1], order[near], end, levels)
    del levels
    found = descend(order, lcp, near[lcp[near] >= least], word.tolist(), begin.tolist(), min_length, exponent)
    if not found:
        return nothing
    start, length, period = np.array(found, np.int64).T
    out = np.stack([row[start], start - begin[start], length, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _kept(spans: Spans, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that no run holds behind its first period. ``first``: the first word of each row."""
    mark = np.zeros(len(spans.row) + 1, np.int64)
    at = first[runs[:, 0]] + runs[:, 1]
    np.add.at(mark, at + runs[:, 3], 1)
    np.add.at(mark, at + runs[:, 2], -1)
    return np.cumsum(mark[:-1]) == 0


def _joined(s: Slice, spans: Spans, keep: np.ndarray) -> list[bytes]:
    """Per row the kept words, joined by one space."""
    row, start, size = spans.row[keep], spans.start[keep], (spans.end - spans.start)[keep]
    to = np.cumsum(size + 1)
    kind = np.int32 if len(s.data) < 1 << 30 else np.int64
    source = np.arange(to[-1] if len(to) else 0, dtype=kind)
    source += np.repeat((start - (to - size - 1)).astype(kind), size + 1)
    data = s.data[np.minimum(source, max(len(s.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    data[to - 1] = 0x20
    last = np.searchsorted(row, np.arange(s.rows), side="right")
    edge = np.concatenate([[0], to])[last]
    whole, edge = data.tobytes(), [0, *edge.tolist()]
    return [whole[lo : max(lo, hi - 1)] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``:
    the words joined by one space, without those that a run holds after its first period."""
    if exponent < 2 or min_length < 2 * exponent:
        raise ValueError("needs an exponent of 2 or more and twice as many words at least")

    def work(s: Slice) -> list[pa.Array]:
        spans = words(s, NOT_SPACE)
        found = runs_of(s, spans, min_length, exponent)
        size = counts_by_row(spans.row, s.rows)
        text = _joined(s, spans, _kept(spans, found, np.cumsum(size) - size))
        where = np.concatenate([[0], np.cumsum(counts_by_row(found[:, 0], s.rows))])
        runs = pa.StructArray.from_arrays([pa.array(found[:, k + 1]) for k in range(3)], names=["start", "length", "period"])
        return [pa.array(size), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), runs), pa.array(text, pa.binary()).cast(pa.string())]

    return add_by_text(docs, text_col, ADDED, work)


def strongest(runs: Column) -> Column:
    """The run of the greatest length/period; of equal ones the first by start, then period. Null if there is none."""
    return F.reduce(
        runs,
        F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, with the repeats that the report plants in one document of ten.

    With ``h`` the crc32 of the decimal id and ``g = floor(h / 10)``: if ``h`` is a multiple of ten and the text has
    ``n > 0`` words, every word from ``a = g % n`` on becomes word ``a + (i - a) % p``, ``p = 1 + floor((n - a) / (3 + g % 8))``.
    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(
            F.struct(w.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")),
            lambda x: F.array_join(
                F.transform(F.sequence(F.lit(0).cast("bigint"), x["n"] - 1), lambda i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "
            ),
        )

    found = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = let(found, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document, repeats planted: n_runs, the strongest run (start, length, period, exponent_milli; four nulls
    without one), runs_sha256 over ``start,length,period`` lines and collapsed_sha256 over the text left."""
    found = find_runs(planted(docs))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
