"""LM scoring by logistic mixing of context predictors.

Texts are read with A-Z in lower case, as pieces: a word and the one white space byte or the end of the
text behind it (words are empty between white space). Each symbol of a piece, the end included, is coded by
the bits of a Huffman code made from the symbol counts of the training texts. For every bit, predictors look
up a slot hashed from a context inside the piece (the word so far, the last three symbols, the last two) and
the place in the code; a slot holds how often training texts had a one and a zero there. The predictions,
stretched to the logistic domain, are combined by weights from the set that the counts of the slots
select (the gate). Weights are fitted gate by gate with Newton's steps; a refining stage then moves a
probability to what was seen at probabilities like it.

Texts are then mixed bit by bit, every piece where it stands (``moving_bits``). One more predictor reaches
across words: its slots are hashed from how the word before ended and the last two symbols of the piece, and
are counted over all training texts in order. It pulls the mix towards its own prediction the more, the
more it has seen. The weights of the mix, of each input and of this predictor move along the text, by the slope of
every ``MOVE`` bits; each text begins with the fitted ones. Texts of like length advance side by side as rows of
arrays. What the fitted model makes of a bit inside its piece is the same wherever the piece stands, so each
block works it out once and the texts look it up.

Along a text the model adapts once more: the refined mix as it was fitted, the mix with moving weights, and mixes
of that with the training counts of whole words are experts whose shares follow, piece by piece, how well they
have done in this text so far. The product of these shared predictions has a closed form, the share-weighted sum
of what each expert gives the whole text. As experts are distributions over texts, so is their mix. The score is
its log10; ``bits_per_byte`` is the same in bits.

Slots have a fixed number and are counted over all training texts by sums, so the model that is broadcast
has a fixed size (about 13 MB). The fitted weights of the gates and the refining counts come from all training
pieces, each bit left out of its own counts: distinct pieces are counted by an aggregate and dealt over
tasks, and in each of ``ROUNDS`` rounds every task sends sums of a fixed size (``Sums``), which are added up.

The base score is the unigram score of words with add-one smoothing. Word counts have no bound, so
they are not broadcast: documents are dealt to blocks of about ``BLOCK_BYTES``, each block sends its
distinct words once, counts are summed over blocks by a window, and words that other blocks hold too
return with their sums. Hot words are a row a block. N and V come from the same pass.

Held-out texts (crc32 of the doc_id modulo 7 is 2) teach nothing. Null texts count as empty; an empty
text is its end alone. A null doc_id counts as the empty string in the remainder. Rows are scored one by
one, so repeated rows and ties need no rule; a repeated row outside the fold teaches twice. Without training
texts all counts are 0. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.arrays import NOT_SPACE, SLICE_BYTES, Slice, Spans, hashes, powers, slices, span_hash, words
from sheaf.llm.near import written
from sheaf.session import arrow_batches

BLOCK_BYTES = 10 << 20
#: Bytes of texts that a counting task takes at a time.
BATCH_BYTES = 2 << 20
END = 256
#: Bits of the slot numbers of each input: the word so far, the last three symbols, the last two.
SLOT_BITS = (20, 18, 16)
INPUTS = len(SLOT_BITS)
_BASE = (0, 1 << 20, (1 << 20) + (1 << 18))
SLOTS = sum(1 << b for b in SLOT_BITS)
#: Bits of the slot numbers of the input that reaches across words; its slots stand behind the others.
ACROSS_BITS = 18
ACROSS = 1 << ACROSS_BITS
TRUST = 4
GATES = TRUST**INPUTS
#: Where the weights start, what holds them there, and how often all pieces are gone through.
START = (0.5, 0.3, 0.2)
RIDGE = 1.0
ROUNDS = 4
CELLS = 32
#: Pieces evaluated at a time.
PART = 4_000
#: Whole-word shares of the last experts; prior shares of the experts: refined mix, moving mix, these.
WORD_SHARES = (0.5, 0.9)
SHARES = (0.2, 0.2, 0.3, 0.3)
#: Bits of a text between two moves of its weights, and how far these go.
MOVE = 32
RATE = 0.002
#: Where the weight of the input across words starts, and the count at which its slots have half of their say.
START_ACROSS = 0.3
DOUBT = 8
#: Texts side by side, and their bits that are in memory at a time.
LANES = 512
WINDOW_BITS = 1 << 18
#: Symbols of the pieces that a task counts at a time; the byte for the end of a text.
FLUSH = 3 << 20
END_BYTE = 0xFF
CHUNK = 1 << 14
_M = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_SYMBOL = tuple(np.random.default_rng(seed).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (41, 42))
_END_WORD = (np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557))


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A code of all symbols: first bit of each in the flat lists, its length, nodes and bits."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    fresh = len(counts)
    while len(heap) > 1:
        a, _, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        above[x], above[y] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh, fresh))
        fresh += 1
    first, length, nodes, bits = [], [], [], []
    for symbol in range(len(counts)):
        path, at = [], symbol
        while at in above:
            path.append(above[at])
            at = above[at][0]
        first.append(len(nodes))
        length.append(len(path))
        for node, bit in reversed(path):
            nodes.append(node - len(counts))
            bits.append(bit)
    return np.array(first), np.array(length), np.array(nodes, np.uint32), np.array(bits, np.uint8)


@dataclass
class Pieces:
    """Distinct pieces: symbols one after another, where each begins, names and counts."""

    symbols: np.ndarray
    start: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    count: np.ndarray

    def part(self, at: np.ndarray) -> Pieces:
        size = np.diff(np.append(self.start, len(self.symbols)))[at]
        start = np.cumsum(size) - size
        symbols = self.symbols[np.repeat(self.start[at] - start, size) + np.arange(int(size.sum()))]
        return Pieces(symbols, start, self.h1[at], self.h2[at], self.count[at])


def pieces(s: Slice) -> tuple[Pieces, np.ndarray]:
    """All pieces of a slice in order, and the row of each."""
    data = s.lower().data
    symbols = np.full(len(data) + s.rows, END, np.int16)
    row = np.repeat(np.arange(s.rows), np.diff(s.offsets))
    symbols[np.arange(len(data)) + row] = data
    last = np.flatnonzero(~np.append(NOT_SPACE, False)[symbols])
    start = np.concatenate([[0], last[:-1] + 1])
    names = []
    for which in (0, 1):
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(_SYMBOL[which][symbols] * powers(which, False, len(symbols) + 1)[:-1], out=sums[1:])
        names.append(span_hash(sums, start, last + 1, which))
    ends = s.offsets[1:] + np.arange(s.rows)
    return Pieces(symbols, start, *names, np.ones(len(start), np.int64)), np.searchsorted(ends, start)


def distinct(p: Pieces, inverse: bool = False):
    """Each piece once, sorted by name, with counts added up."""
    order = np.argsort(p.h1)
    h1, h2 = p.h1[order], p.h2[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    at = np.flatnonzero(new)
    out = p.part(order[at])
    out.count = np.add.reduceat(p.count[order], at) if len(at) else p.count
    if not inverse:
        return out
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return out, back


def joined(parts: list[Pieces]) -> Pieces:
    size = np.cumsum([0, *(len(p.symbols) for p in parts)])[:-1]
    start = np.concatenate([p.start + at for p, at in zip(parts, size, strict=True)]) if parts else np.zeros(0, np.int64)
    empty = Pieces(np.zeros(0, np.int16), start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    every = [empty, *parts]
    return Pieces(*(np.concatenate([getattr(p, f) for p in every]) if f != "start" else start for f in ("symbols", "start", "h1", "h2", "count")))


def all_pieces(texts, limit: int = SLICE_BYTES, each: Callable[[Pieces, np.ndarray, np.ndarray], None] | None = None) -> Pieces:
    """The distinct pieces of a text column. ``each`` gets those of every slice, and for all pieces in order their
    number among them and their row."""
    parts: list[Pieces] = []
    for s in slices(texts, limit):
        p, row = pieces(s)
        own, back = distinct(p, True)
        if each:
            each(own, back, row)
        parts.append(own)
        if len(parts) > 16:
            parts = [distinct(joined(parts))]
    return distinct(joined(parts))


@dataclass
class Bits:
    """The coded bits of pieces, each with its piece and its slot for every input, and a name of the last two
    symbols and the place in the code."""

    piece: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    name: np.ndarray


def parts(p: Pieces) -> Iterator[tuple[np.ndarray, Pieces]]:
    """The pieces in parts, and where they stand; pieces that begin alike come together."""
    n = len(p.start)
    size = np.diff(np.append(p.start, len(p.symbols)))
    begin = np.zeros(n, np.uint64)
    for k in range(7):
        at = np.minimum(p.start + k, max(len(p.symbols) - 1, 0))
        begin = begin << np.uint64(9) | np.where(k < size, p.symbols[at] + 1, 0).astype(np.uint64)
    order = np.argsort(begin)
    for lo in range(0, n, PART):
        at = order[lo : lo + PART]
        yield at, p.part(at)


@dataclass
class Steps:
    """The distinct steps of pieces, a step being a symbol and all that stands before it in its piece. What a
    symbol costs hangs on its step alone, so that many pieces share the bits of their beginnings."""

    at: np.ndarray
    of: np.ndarray
    owner: np.ndarray

    def weight(self, p: Pieces) -> np.ndarray:
        """How often each step was taken."""
        return np.bincount(self.of, weights=p.count[self.owner], minlength=len(self.at))


def steps(p: Pieces) -> Steps:
    n = len(p.symbols)
    owner = np.repeat(np.arange(len(p.start)), np.diff(np.append(p.start, n)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[0][p.symbols] * powers(0, False, n + 1)[:-1], out=sums[1:])
    name = span_hash(sums, p.start[owner], np.arange(1, n + 1), 0)
    _, at, of = np.unique(name, return_index=True, return_inverse=True)
    return Steps(at, of.reshape(-1), owner)


def coded(p: Pieces, code, at: np.ndarray | None = None) -> Bits:
    """The bits of all symbols; with ``at``, of the symbols that stand there, whose numbers then name the bits."""
    symbol, owner, three, two = _last_symbols(p)
    contexts = [_word_so_far(symbol, p.start, owner), three, two]
    symbols = p.symbols
    if at is not None:
        symbols, contexts, owner = symbols[at], [c[at] for c in contexts], np.arange(len(at))
    flat, each, node = _bits(symbols, code)
    names = [_names(c, each, node) for c in contexts]
    slots = [(x >> np.uint32(32 - SLOT_BITS[i])).astype(np.int64) + _BASE[i] for i, x in enumerate(names)]
    return Bits(np.repeat(owner, each), code[3][flat], slots, names[2])


def _last_symbols(p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols from 1 on, the piece of each, and the last three and two of the piece before each."""
    n = len(p.symbols)
    owner = np.repeat(np.arange(len(p.start)), np.diff(np.append(p.start, n)))
    place = np.arange(n) - p.start[owner]
    symbol = p.symbols.astype(np.uint32) + np.uint32(1)
    last = []
    for k in (1, 2, 3):
        before = np.zeros(n, np.uint32)
        before[k:] = symbol[:-k]
        before[place < k] = 0
        last.append(before)
    two = last[0] | last[1] << np.uint32(9)
    return symbol, owner, two ^ last[2] * np.uint32(_M[2]), two


def _bits(symbols: np.ndarray, code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the code of the bits of symbols, how many each has, and what stands for the places in hashes."""
    first, length, nodes, _ = code
    each = length[symbols]
    ends = np.cumsum(each)
    flat = np.repeat(first[symbols] - ends + each, each) + np.arange(int(each.sum()))
    return flat, each, nodes[flat] * np.uint32(_M[1])


def _names(context: np.ndarray, each: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Hashes of the context of a symbol and the place in the code, for every bit."""
    x = np.repeat(context * np.uint32(_M[0]), each) + node
    x ^= x >> np.uint32(15)
    x *= np.uint32(_M[2])
    x ^= x >> np.uint32(13)
    x *= np.uint32(_M[0])
    return x


def _word_so_far(symbol: np.ndarray, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of the symbols of the piece before each symbol."""
    n = len(symbol)
    power = np.full(n + 1, np.uint32(_M[1]), np.uint32)
    inverse = np.full(n + 1, np.uint32(pow(_M[1], -1, 1 << 32)), np.uint32)
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum(symbol * np.uint32(_M[2]) * power[:-1], out=sums[1:], dtype=np.uint32)
    return (sums[:-1] - sums[start[owner]]) * inverse[start[owner]]


def bit_counts(p: Pieces, code) -> np.ndarray:
    """How many bits each piece has."""
    return np.add.reduceat(code[1][p.symbols], p.start) if len(p.start) else np.zeros(0, np.int64)


def tails(p: Pieces) -> np.ndarray:
    """A hash of the last three symbols of each piece: the end of its word and the white space."""
    end = np.append(p.start[1:], len(p.symbols))
    out = np.zeros(len(p.start), np.uint32)
    for k in (1, 2, 3):
        at = end - k
        own = np.where(at >= p.start, p.symbols[np.maximum(at, 0)].astype(np.uint32) + np.uint32(1), np.uint32(0))
        out = out << np.uint32(9) | own
    out = (out + np.uint32(1)) * np.uint32(_M[0])
    out ^= out >> np.uint32(15)
    return out * np.uint32(_M[1])


def tails_before(tail: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For pieces in order, the tail of the piece before; 0 where a text begins."""
    out = np.zeros(len(tail), np.uint32)
    out[1:] = np.where(row[1:] == row[:-1], tail[:-1], np.uint32(0))
    return out


def across_slots(name: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Slots of the input across words, among its own: how the word before ended, with the name of the bit, of
    which the last binary digit does not count."""
    x = name | np.uint32(1)
    x ^= before
    x *= np.uint32(_M[2])
    x ^= x >> np.uint32(16)
    x *= np.uint32(_M[0])
    x >>= np.uint32(32 - ACROSS_BITS)
    return x.astype(np.int64)


def code_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often each byte and the end occur in ``train`` rows, and how many tokens these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(END + 2, np.int64)
        for batch in batches:
            batch = batch.filter(batch.column("train"))
            held[END:] += batch.num_rows
            for s in slices(batch.column("text")):
                held[:END] += np.bincount(s.lower().data, minlength=END)
                held[END + 1] += len(words(s, NOT_SPACE).start)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(END + 2)), pa.array(held)], names=["symbol", "n"])
        pa.default_memory_pool().release_unused()  # the worker idles while others run

    counts = docs.select("text", "train").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        found = counts.toArrow()  # 258 rows
    out = np.zeros(END + 2, np.int64)
    out[found.column("symbol").to_numpy()] = found.column("n").to_numpy()
    return out[: END + 1], int(out[END + 1])


def slot_counts(docs: DataFrame, code) -> tuple[np.ndarray, DataFrame]:
    """Ones and zeros of every slot over ``train`` rows, in turn, those across words last, and the distinct pieces
    of these rows, ``piece, n``.

    A task sends its counts as chunks; these are added up in groups of about the root of their number,
    then once more, so no group grows in proportion to the input. Its pieces are distinct between flushes,
    so a frequent piece is a row a flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, own = np.zeros(2 * (SLOTS + ACROSS), np.int64), joined([])
        across = held[2 * SLOTS :]
        for batch in batches:
            texts = batch.filter(batch.column("train")).column("text")
            own = distinct(joined([own, all_pieces(texts, each=lambda *x: _count_across(across, *x, code))]))
            if len(own.symbols) > FLUSH:
                _count(held, own, code)
                yield from piece_rows(own)
                own = joined([])
        _count(held, own, code)
        yield from piece_rows(own)
        del own
        n = -(-len(held) // CHUNK)
        yield _rows(pa.array(range(n), pa.int32()), task, pa.array([_packed(held[i * CHUNK : (i + 1) * CHUNK]) for i in range(n)], pa.binary()), np.zeros(n, np.int64))
        del held, across
        pa.default_memory_pool().release_unused()

    schema = "chunk int, task int, counts binary, n bigint"
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        rows = written(docs.select("text", "train").mapInArrow(run, schema), "slots")
    every = rows.filter("chunk is null").groupBy(F.col("counts").alias("piece")).agg(F.sum("n").alias("n"))
    # Sorted, so that pieces which begin alike reach the rounds together.
    return _added(rows.filter("chunk is not null").select("chunk", "task", "counts")), written(every.sortWithinPartitions("piece"), "pieces")


def _rows(chunk: pa.Array, task: int, counts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([chunk, pa.array(np.full(len(n), task, np.int32)), counts, pa.array(n)], names=["chunk", "task", "counts", "n"])


def piece_rows(p: Pieces) -> Iterator[pa.RecordBatch]:
    """A row for each piece, its symbols as bytes."""
    for at in range(0, len(p.start), PART):
        own = p.part(np.arange(at, min(at + PART, len(p.start))))
        n = len(own.start)
        data = np.where(own.symbols == END, END_BYTE, own.symbols).astype(np.uint8)
        offsets = np.append(own.start, len(data)).astype(np.int32)
        names = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        yield _rows(pa.nulls(n, pa.int32()), 0, names, own.count)


def read_pieces(names: pa.Array, n: pa.Array) -> Pieces:
    """What ``piece_rows`` wrote; the pieces get no hashes."""
    offsets = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4).astype(np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    unnamed = np.zeros(len(names), np.uint64)
    symbols, last = data.astype(np.int16), offsets[1:] - offsets[0] - 1
    symbols[last[symbols[last] == END_BYTE]] = END  # otherwise white space stands there
    return Pieces(symbols, offsets[:-1] - offsets[0], unnamed, unnamed, n.to_numpy())


def _count(held: np.ndarray, p: Pieces, code) -> None:
    for _, own in parts(p):
        s = steps(own)
        b = coded(own, code, s.at)
        weight = s.weight(own).astype(np.int64)[b.piece]
        for slot in b.slots:
            np.add.at(held, slot * 2 + b.bit, weight)


def _count_across(held: np.ndarray, p: Pieces, of: np.ndarray, row: np.ndarray, code) -> None:
    """Count the bits of all pieces in order, given by their numbers among distinct ones, after the piece before."""
    flat, each, node = _bits(p.symbols, code)
    name = _names(_last_symbols(p)[3], each, node) & ~np.uint32(1) | code[3][flat]
    size = bit_counts(p, code)
    start = np.cumsum(size) - size
    before = tails_before(tails(p)[of], row)
    few = np.zeros(len(held), np.uint32)  # half as wide, for a slice at a time
    for lo in range(0, len(of), PART):
        own = of[lo : lo + PART]
        n = size[own]
        ends = np.cumsum(n)
        x = name.take(np.repeat(start[own] - ends + n, n) + np.arange(ends[-1]))
        slot = across_slots(x, np.repeat(before[lo : lo + PART], n))
        slot += slot
        slot += x & np.uint32(1)
        np.add.at(few, slot, np.uint32(1))
    held += few


def _packed(held: np.ndarray) -> bytes:
    return zlib.compress(held.astype("<i8").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i8")


def _sum(group: pa.Table) -> pa.Table:
    held = np.zeros(CHUNK, np.int64)
    for x in group.column("counts"):
        own = _unpacked(x.as_py())
        held[: len(own)] += own
    packed = pa.array([_packed(held[: len(own)])], pa.binary())
    return pa.table({"chunk": group.column("chunk")[:1], "task": group.column("task")[:1], "counts": packed})


def _added(parts: DataFrame) -> np.ndarray:
    schema = "chunk int, task int, counts binary"
    few = parts.withColumn("part", F.floor(F.sqrt("task")).cast("int")).groupBy("chunk", "part").applyInArrow(_sum, schema)
    found = few.groupBy("chunk").applyInArrow(_sum, schema).toArrow()  # a fixed number of rows
    held = [np.zeros(0, np.int64)] * found.num_rows
    for i, x in zip(found.column("chunk").to_pylist(), found.column("counts"), strict=True):
        held[i] = _unpacked(x.as_py())
    return np.concatenate(held) if held else np.zeros(2 * SLOTS, np.int64)


def _trust(total: np.ndarray) -> np.ndarray:
    return (total > 0).astype(np.int8) + (total > 3) + (total > 30)


def _stretch(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """ln(p / (1 - p)); the two logarithms keep it finite at any count."""
    return np.log(ones + np.float32(0.15)) - np.log(zeros + np.float32(0.15))


@dataclass
class Sums:
    """What one round over pieces tells of each gate at its weights: loss, slope, curvature, and how often a
    zero and a one was seen at each probability."""

    loss: np.ndarray
    slope: np.ndarray
    curve: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(flat: np.ndarray) -> Sums:
        each = flat.reshape(GATES, -1)
        at = 1 + INPUTS + INPUTS * INPUTS
        return Sums(each[:, 0], each[:, 1 : 1 + INPUTS], each[:, 1 + INPUTS : at].reshape(GATES, INPUTS, INPUTS), each[:, at:].reshape(GATES, CELLS, 2))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.loss[:, None], self.slope, self.curve.reshape(GATES, -1), self.seen.reshape(GATES, -1)], axis=1).ravel()


SUMS = GATES * (1 + INPUTS + INPUTS * INPUTS + 2 * CELLS)


@dataclass
class Mixer:
    """Counts of every slot, the weights of every gate, and what was seen at each gate and probability."""

    code: tuple
    ones: np.ndarray
    zeros: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def of(code, counts: np.ndarray) -> Mixer:
        weights = np.tile(np.array(START, np.float64), (GATES, 1))
        return Mixer(code, counts[1::2].astype(np.float32), counts[0::2].astype(np.float32), weights, np.zeros((GATES, CELLS, 2)))

    def inputs(self, b: Bits, without: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and gates; ``without`` leaves the bit itself out of the counts, for bits
        that were counted."""
        gate = np.zeros(len(b.bit), np.int64)
        x = np.empty((INPUTS, len(b.bit)), np.float32)
        for i, slot in enumerate(b.slots):
            if without:
                ones, zeros = np.maximum(self.ones[slot] - b.bit, 0), np.maximum(self.zeros[slot] - (1 - b.bit), 0)
                trust, x[i] = _trust(ones + zeros), _stretch(ones, zeros)
            else:
                trust, x[i] = self.known[0][slot], self.known[1][slot]
            gate = gate * TRUST + trust
        return x.T, gate

    @cached_property
    def across(self) -> np.ndarray:
        """Say, from 0 to 1, of every slot across words, and its stretched prediction times that, as one number that
        is looked up at once."""
        ones, zeros = self.ones[SLOTS:], self.zeros[SLOTS:]
        out = np.zeros((ACROSS, 2), np.float32)  # a model without such counts has no say
        out[: len(ones), 0] = (ones + zeros) / (ones + zeros + np.float32(DOUBT))
        out[: len(ones), 1] = _stretch(ones, zeros) * out[: len(ones), 0]
        return out.view(np.complex64).ravel()

    @cached_property
    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Trust and stretched prediction of every slot."""
        ones, zeros = self.ones[:SLOTS], self.zeros[:SLOTS]
        return _trust(ones + zeros), _stretch(ones, zeros)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = self.weights[:, 0][gate] * x[:, 0]
        for i in range(1, INPUTS):
            out += self.weights[:, i][gate] * x[:, i]
        return np.clip(out, -12, 12, out=out)

    def sums(self, p: Pieces, last: bool = False) -> Sums:
        """One round over counted pieces. No step follows the last one, which tells no slope and curvature."""
        out = Sums.of(np.zeros(SUMS))
        for _, own in parts(p):
            s = steps(own)
            b = coded(own, self.code, s.at)
            x, gate = self.inputs(b, without=True)
            weight = s.weight(own)[b.piece]
            mixed = self.mix(x, gate)
            q = 1 / (1 + np.exp(-mixed))
            cell = (gate * CELLS + ((mixed + 12) * ((CELLS - 1) / 24) + 0.5).astype(np.int64)) * 2 + b.bit
            out.seen += np.bincount(cell, weights=weight, minlength=GATES * CELLS * 2).reshape(GATES, CELLS, 2)
            out.loss += np.bincount(gate, weights=-weight * np.log(np.where(b.bit == 1, q, 1 - q)), minlength=GATES)
            if last:
                continue
            error, steep = weight * (b.bit - q), weight * q * (1 - q)
            for i in range(INPUTS):
                out.slope[:, i] += np.bincount(gate, weights=error * x[:, i], minlength=GATES)
                for j in range(i + 1):
                    out.curve[:, i, j] += np.bincount(gate, weights=steep * x[:, i] * x[:, j], minlength=GATES)
        return out

    def fit(self, round_: Callable[[Mixer, bool], Sums]) -> None:
        """Newton's steps of every gate by itself; a step after which the loss is greater is halved."""
        start = np.array(START)
        best, least, step = self.weights.copy(), np.full(GATES, np.inf), np.zeros((GATES, INPUTS))
        for k in range(ROUNDS):
            last = k == ROUNDS - 1
            found = round_(self, last)
            away = self.weights - start
            loss = found.loss + RIDGE / 2 * (away**2).sum(axis=1)
            better = loss < least
            best[better], least[better], self.refined[better] = self.weights[better], loss[better], found.seen[better]
            if last:
                break
            lower = np.tril(found.curve)
            curve = lower + np.tril(lower, -1).transpose(0, 2, 1) + RIDGE * np.eye(INPUTS)
            newton = np.linalg.solve(curve, (found.slope - RIDGE * away)[..., None])[..., 0]
            step = np.where(better[:, None], newton, step / 2)
            self.weights = best + step
        self.weights = best

    def learn(self, p: Pieces) -> None:
        """Fit the weights to counted pieces, and note what was seen at each gate and probability."""
        self.fit(lambda model, last: model.sums(p, last))

    def bits_of(self, p: Pieces) -> np.ndarray:
        """What each piece costs in bits: refined mix, plain mix, and the plain mix of its last symbol alone."""
        out = np.zeros((len(p.start), 3))
        for _ in self.evaluated(p, out):
            pass
        return out

    def evaluated(self, p: Pieces, out: np.ndarray) -> Iterator[tuple[np.ndarray, Pieces, Steps, Bits, np.ndarray, np.ndarray]]:
        """Fill in ``bits_of``, part by part: where its pieces stand, these, their steps and bits, inputs and mix."""
        seen_ones, seen = self.refined[..., 1].ravel(), self.refined.sum(axis=-1).ravel()
        for where, own in parts(p):
            n = len(own.start)
            s = steps(own)
            b = coded(own, self.code, s.at)
            x, gate = self.inputs(b)
            mixed = self.mix(x, gate)
            plain = 1 / (1 + np.exp(-mixed))
            cell = gate * CELLS + ((mixed + 12) * ((CELLS - 1) / 24) + 0.5).astype(np.int64)
            better = (seen_ones[cell] + 20 * plain) / (seen[cell] + 20)
            one = b.bit == 1
            for k, q in enumerate((better, plain)):
                q = np.clip(q, 1e-6, 1 - 1e-6)
                cost = -np.log2(np.where(one, q, 1 - q))
                each = np.bincount(b.piece, weights=cost, minlength=len(s.at))[s.of]
                out[where, k] = np.bincount(s.owner, weights=each, minlength=n)
            out[where, 2] = each[np.append(own.start[1:], len(own.symbols)) - 1]
            yield where, own, s, b, x, mixed


@dataclass
class Coded:
    """The bits of the steps of pieces as the model with the fitted weights sees them: where those of each symbol
    begin, the mix and the inputs, and names whose last binary digit is the bit."""

    first: np.ndarray
    inputs: np.ndarray
    name: np.ndarray

    @staticmethod
    def of(model: Mixer, p: Pieces) -> tuple[Coded, np.ndarray]:
        """Also what ``bits_of`` tells of the pieces."""
        costs, end = np.zeros((len(p.start), 3)), np.append(p.start[1:], len(p.symbols))
        most = int(bit_counts(p, model.code).sum()) + MOVE  # of which shared steps leave a part untouched
        first, inputs, name = np.empty(len(p.symbols), narrow(most)), np.empty((most, 1 + INPUTS), np.float32), np.empty(most, np.uint32)
        lo = 0
        for where, own, s, b, x, mixed in model.evaluated(p, costs):
            size = model.code[1][own.symbols[s.at]]
            first[_ranges(p.start[where], end[where])] = (np.cumsum(size) - size + lo)[s.of]
            hi = lo + len(mixed)
            inputs[lo:hi, 0], inputs[lo:hi, 1:], name[lo:hi] = mixed, x, b.name & ~np.uint32(1) | b.bit
            lo = hi
        inputs[lo : lo + MOVE], name[lo : lo + MOVE] = 0, 0
        return Coded(first, inputs[: lo + MOVE], name[: lo + MOVE]), costs


def narrow(n: int) -> type:
    """The type of numbers up to ``n``, of which there are many."""
    return np.int32 if n < 1 << 31 else np.int64


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each ``lo`` up to its ``hi``, one after another."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


def moving_bits(model: Mixer, p: Pieces, piece: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """What all pieces of texts in order, ``piece`` of ``p`` in ``row``, cost in bits by weights that move along
    each text; and what ``Mixer.bits_of`` tells of the distinct ones.

    Texts of like length advance side by side, each with weights of its own. These start with what is fitted and
    move after every ``MOVE`` bits, by the slope of these bits. What is in memory is a stretch of the texts at a time.
    """
    table, costs = Coded.of(model, p)
    out, before = np.zeros(len(piece)), tails_before(tails(p)[piece], row)
    start, end = p.start, np.append(p.start[1:], len(p.symbols))
    # Bits of symbols and of distinct pieces, and how many stand before them when these lie one after another.
    length, size = model.code[1].astype(np.int16)[p.symbols], bit_counts(p, model.code)
    symbol_ends, piece_begins = np.cumsum(length, dtype=narrow(int(size.sum()))), np.cumsum(size) - size
    bits = np.bincount(row, weights=size[piece], minlength=rows).astype(np.int64)
    ends = np.cumsum(size[piece], dtype=narrow(int(bits.sum())))  # of all pieces, from the first text's begin
    moves, base = -(-bits // MOVE), np.cumsum(bits) - bits
    # The piece in which each move begins, and the piece behind each text.
    border = np.searchsorted(ends, (np.repeat(base, moves) + MOVE * _ranges(np.zeros_like(moves), moves)).astype(ends.dtype), side="right").astype(narrow(len(ends)))
    places, behind = np.cumsum(moves) - moves, np.searchsorted(row, np.arange(rows), side="right")
    across, inputs = model.across, table.inputs.view(np.complex128).ravel()  # four numbers looked up at once

    def taken(texts: np.ndarray, t: int, till: int) -> tuple[np.ndarray, ...]:
        """Moves from ``t`` up to ``till`` of texts that have such, the longest first: their number for each text;
        rows of the table and tails of words before, a row a move; pieces, where their bits begin and how many."""
        lo, hi = base[texts] + t * MOVE, base[texts] + np.minimum(bits[texts], till * MOVE)
        own = np.minimum(moves[texts], till) - t
        spare = own * MOVE - (hi - lo)  # behind a text stand bits that count nowhere
        # The pieces and their symbols, those at the borders in part.
        from_ = border[places[texts] + t]
        to = np.where(moves[texts] > till, border[np.minimum(places[texts] + till, len(border) - 1)] + 1, behind[texts])
        at, last = _ranges(from_, to), np.cumsum(to - from_) - 1
        which, lane = piece[at], np.repeat(np.arange(len(texts)), to - from_)
        stop = ends[at].astype(np.int64)
        begin = stop - size[which]
        left = np.maximum(begin, lo[lane])
        run = np.minimum(stop, hi[lane]) - left
        place = (np.cumsum(own) - own)[lane] * MOVE + left - lo[lane]
        begin_, end_ = start[which], end[which]
        part = np.flatnonzero(run < size[which])
        off = piece_begins[which[part]] + left[part] - begin[part]
        begin_[part] = np.searchsorted(symbol_ends, off, side="right")
        end_[part] = np.where(run[part] > 0, np.searchsorted(symbol_ends, off + run[part] - 1, side="right") + 1, begin_[part])
        some, count = _ranges(begin_, end_), end_ - begin_
        each, lane = length[some].astype(np.int64), np.repeat(lane, count)
        ahead = symbol_ends[some] - each + np.repeat(begin - piece_begins[which], count)
        cut = np.maximum(lo[lane] - ahead, 0)
        each = np.minimum(each, hi[lane] - ahead) - cut
        each[np.cumsum(count)[last] - 1] += spare
        stops = np.cumsum(each)
        of = np.repeat(table.first[some] + cut - stops + each, each) + np.arange(stops[-1])
        wide = run.copy()
        wide[last] += spare
        tail = np.repeat(before[at], wide)
        return own, of.reshape(-1, MOVE), tail.reshape(-1, MOVE), at, place, run

    def advance(texts: np.ndarray, t: int, till: int, weights: np.ndarray, weight: np.ndarray) -> None:
        own, of, tail, at, place, run = taken(texts, t, till)
        # By time and then by text, so that what moves at once lies together.
        active = np.searchsorted(-own, -np.arange(own[0]), side="left")
        step = np.repeat(np.arange(own[0]), active)
        first = np.cumsum(active) - active
        turn = (np.cumsum(own) - own)[np.arange(len(step)) - first[step]] + step
        of = of.take(turn, axis=0)
        x = inputs.take(of).view(np.float32).reshape(-1, MOVE, 1 + INPUTS)
        name = table.name.take(of)
        far = across.take(across_slots(name, tail.take(turn, axis=0)))
        y = far.imag - far.real * x[:, :, 0]
        error = (name & np.uint32(1)).astype(np.float32)
        for k, m in zip(first.tolist(), active.tolist(), strict=True):
            x_, y_, error_ = x[k : k + m], y[k : k + m], error[k : k + m]
            z = np.matvec(x_, weights[:m])
            z += weight[:m, None] * y_
            np.clip(z, -12, 12, out=z)
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            error_ -= np.reciprocal(z, out=z)
            weights[:m] += np.float32(RATE) * np.vecmat(error_, x_)
            weight[:m] += np.float32(RATE) * np.vecdot(y_, error_)
        # The error is how far the bit's probability is from 1.
        cost = np.empty(error.shape, np.float32)
        cost[turn] = np.log1p(-np.abs(error))
        cost = cost.ravel()
        some = run > 0
        at, place, run = at[some], place[some], run[some]
        # A sum goes on to where the next begins, over the bits behind a text too.
        behind_ = np.append(place[1:], len(cost))
        cost[_ranges(place + run, behind_)] = 0
        out[at] -= np.add.reduceat(cost, place) / math.log(2)

    order = np.argsort(-bits, kind="stable")
    for lanes in (order[k : k + LANES] for k in range(0, rows, LANES)):
        weights = np.tile(np.array([1] + [0] * INPUTS, np.float32), (len(lanes), 1))
        weight = np.full(len(lanes), START_ACROSS, np.float32)
        t = 0
        while t < moves[lanes[0]]:
            n = int(np.searchsorted(-moves[lanes], -t))
            till = t + max(1, WINDOW_BITS // MOVE // n)
            advance(lanes[:n], t, till, weights, weight)
            t = till
    return out, costs


def learn_all(kept: DataFrame, model: Mixer) -> None:
    """``Mixer.learn`` over all pieces that ``slot_counts`` found."""
    spark = kept.sparkSession
    counts = spark.sparkContext.broadcast((model.code, model.ones[:SLOTS], model.zeros[:SLOTS]))

    def round_(now: Mixer, last: bool) -> Sums:
        weights = now.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Mixer(*counts.value, weights, np.zeros(0))
            held = np.zeros(SUMS)
            for batch in batches:
                held += own.sums(read_pieces(batch.column("piece"), batch.column("n")), last).flat()
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["place", "n"])

        found = kept.mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # SUMS rows at most
        flat = np.zeros(SUMS)
        flat[found.column("place").to_numpy()] = found.column("n").to_numpy()
        return Sums.of(flat)

    model.fit(round_)


def shared_bits(spent: np.ndarray) -> np.ndarray:
    """Bits of texts under the experts' mix, from what each expert spends on the whole text."""
    x = np.log2(np.array(SHARES)) - spent
    top = x.max(axis=1)
    return -(top + np.log2(np.exp2(x - top[:, None]).sum(axis=1)))


def _word_keys(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and 128-bit names of the tokens of a slice: words, and one end for each row."""
    s = s.lower()
    spans = words(s, NOT_SPACE)
    row = np.concatenate([spans.row, np.arange(s.rows)])
    h1, h2 = (np.concatenate([hashes(s.data, spans, w), np.full(s.rows, _END_WORD[w])]) for w in (0, 1))
    return row, h1, h2


def _unique(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h1)
    h1, h2, n = h1[order], h2[order], n[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    at = np.flatnonzero(new)
    return h1[at], h2[at], np.add.reduceat(n, at) if len(at) else n


def _block_words(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a block with their counts in its training rows (0 for tokens only held out)."""
    train = group.column("train").to_numpy()
    parts = []
    for s in slices(group.column("text")):
        row, h1, h2 = _word_keys(s)
        parts.append(_unique(h1, h2, train[s.first + row].astype(np.int64)))
    return _unique(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def word_sums(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, h1, h2, total`` of the tokens that several blocks hold, and one row with ``v``."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h1, h2, n = _block_words(group)
        return pa.table({"block": pa.array([key[0].as_py()] * len(h1), pa.int32()), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "n": n})

    own = blocks.groupBy("block").applyInArrow(run, "block int, h1 bigint, h2 bigint, n bigint")
    word = Window.partitionBy("h1", "h2")  # a row a block at most, however frequent the word
    summed = own.select("*", F.sum("n").over(word).alias("total"), F.count("*").over(word).alias("blocks"), F.min("block").over(word).alias("first"))
    known = F.when((F.col("block") == F.col("first")) & (F.col("total") > 0), 1).otherwise(0)
    v = summed.agg(F.sum(known).cast("bigint").alias("v"), F.min(F.col("blocks") * 0).alias("part"))
    return summed.filter("blocks > 1").select("block", "h1", "h2", "total"), v


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` per document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (remainder(7) != 2).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    symbols, n = code_counts(docs)
    code = huffman(symbols)
    counts, kept = slot_counts(docs, code)
    model = Mixer.of(code, counts)
    learn_all(kept, model)
    mixer = spark.sparkContext.broadcast(model)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    # One plan holds the words and the scores, so that documents are dealt to blocks once.
    shared, v = word_sums(blocks)

    def run(group: pa.Table, sums: pa.Table) -> pa.Table:
        return _scored(group, sums, mixer.value, n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, logs double, score double, bits_per_byte double, part bigint"
    scored = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, schema)
    all_ = scored.join(F.broadcast(v), "part")  # a single row
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 1) + F.col("v"))
    return all_.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "bits_per_byte")


def _scored(group: pa.Table, sums: pa.Table, model: Mixer, n: int) -> pa.Table:
    train = group.column("train").to_numpy()
    rows = len(train)
    # Distinct pieces of the block, and for every piece in order its row and its number among them.
    parts, places = [], []
    for s in slices(group.column("text")):
        p, row = pieces(s)
        own, back = distinct(p, True)
        parts.append(own)
        places.append((row + s.first, back))
    every, into = distinct(joined(parts), True)
    at = np.cumsum([0, *(len(p.start) for p in parts)])
    row = np.concatenate([r for r, _ in places] or [np.zeros(0, np.int64)]).astype(np.int32)
    piece = np.concatenate([into[lo + back] for lo, (_, back) in zip(at[:-1], places, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int32)
    del parts, places
    # The words of the pieces with their counts in training texts; one more for the ends.
    m = len(every.start)
    stop = np.append(every.start[1:], len(every.symbols)) - 1
    full = stop > every.start
    h1, h2 = (np.append(x, _END_WORD[w]) for w, x in enumerate(_word_names(every, stop)))
    mine = np.bincount(piece, weights=train[row], minlength=m)
    word = np.unique(h1, return_inverse=True)[1].reshape(-1)
    count = np.bincount(word, weights=np.append(mine * full, train.sum()))
    table = np.unique(h1, return_index=True)[1]
    known_at = _find(*(sums.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")), h1[table], h2[table])
    count[known_at] = sums.column("total").to_numpy()
    c = np.where(np.append(full, True), count[word], 0)
    end, c = c[-1], c[:-1]
    tokens = np.bincount(row, weights=full[piece], minlength=rows)[:rows].astype(np.int64) + 1
    known = np.bincount(row, weights=(full & (c > 0))[piece], minlength=rows)[:rows].astype(np.int64) + (end > 0)
    logs = np.bincount(row, weights=np.where(full, np.log10(c + 1), 0)[piece], minlength=rows)[:rows] + math.log10(end + 1)
    moved, bits = moving_bits(model, every, piece, row, rows)
    whole = (np.where(full, c, 0) / max(n, 1) * np.exp2(-bits[:, 2]))[piece]
    rest = np.exp2(-np.minimum(moved, 1000))
    add = lambda x: np.bincount(row, weights=x, minlength=rows)[:rows]
    spent = np.stack([add(bits[piece, 0]), add(moved), *(add(-np.log2(w * whole + (1 - w) * rest)) for w in WORD_SHARES)], axis=1)
    total = shared_bits(spent)
    size = pc.fill_null(pc.binary_length(group.column("text")), 0).to_numpy().astype(np.int64)
    out = pa.table(
        {
            "doc_id": group.column("doc_id"),
            "held_out": pa.array(~train),
            "n_tokens": tokens,
            "n_known": known,
            "train_tokens": np.full(rows, n),
            "logs": logs,
            "score": -total * math.log10(2),
            "bits_per_byte": total / np.maximum(size, 1),
            "part": np.zeros(rows, np.int64),
        }
    )
    pa.default_memory_pool().release_unused()  # the next group comes into memory of its own
    return out


def _word_names(p: Pieces, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the words of pieces, ``PART`` at a time, so that sums and powers stay short."""
    names = (np.empty(len(p.start), np.uint64), np.empty(len(p.start), np.uint64))
    for at in range(0, len(p.start), PART):
        to = min(at + PART, len(p.start))
        lo = p.start[at]
        data = np.minimum(p.symbols[lo : stop[to - 1]], 255).astype(np.uint8)
        spans = Spans(np.zeros(to - at, np.int64), p.start[at:to] - lo, stop[at:to] - lo)
        for w in (0, 1):
            names[w][at:to] = hashes(data, spans, w)
    return names


def _find(h1: np.ndarray, h2: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Where each pair stands in a sorted table that has it. Equal first halves are stepped over."""
    at = np.searchsorted(t1, h1)
    while len(at):
        wrong = t2[at] != h2
        if not wrong.any():
            break
        at[wrong] += 1
    return at
