"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each match of the split pattern is encoded by itself. A piece that is a token as a whole is that
token. Any other piece is merged over a segment tree: leaf ``i`` holds the rank of joining the part
that begins at byte ``i`` with the part after it, inner nodes hold the least rank below and, among
equals, the leftmost place. A merge takes the root, joins two parts and renews the two or three leaves
it touches, each in logarithmic time, so a piece of a million bytes needs some twenty million steps
and not a trillion.

Null texts are encoded as empty ones. Rows are independent: repeated rows and ties need no rule, an
empty table gives an empty table. Only the named column is read; the added columns have names the
caller chooses. Memory: one Arrow batch and a bounded table of pieces already encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import threading
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
#: Pieces kept with their ids in each of two generations, and the longest that is kept.
KEPT_PIECES, KEPT_CHARS = 300_000, 40
#: After so many seconds without a task a worker lets its pieces go.
IDLE_SECONDS = 2.0


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))  # where the part before it begins
    size = 1
    while size < n:
        size *= 2
    # A node is rank << 32 | place: the least one is the least rank, leftmost.
    tree = [NONE] * (2 * size)

    def rank(i: int) -> int:
        j = after[i]
        r = ranks.get(piece[i : after[j]]) if j < n else None
        return NONE if r is None else r << 32 | i

    def put(i: int, value: int) -> None:
        at = i + size
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return  # nothing changes further up
            tree[at] = value

    for i in range(n - 1):
        tree[size + i] = rank(i)
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] < NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        put(j, NONE)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


_SPACE = r"\p{White_Space}"


def split_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with white space as Unicode defines it, as the public encoders take it."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}"))


def ascii_pattern(pattern: str) -> re.Pattern:
    """The same for texts of ASCII alone, where classes are short and the search is faster."""
    for old, new in ((r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[\t-\r ]"), (r"\S", r"[^\t-\r ]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find, self.find_ascii = ranks, split_pattern(pattern).findall, ascii_pattern(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.users, self.turn, self.lock = 0, 0, threading.Lock()

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}

    def __enter__(self) -> Encoder:
        with self.lock:
            self.users += 1
            self.turn += 1
        return self

    def __exit__(self, *_) -> None:
        """Pieces serve the next tasks of a worker, but one that idles gives them back to what runs then."""
        with self.lock:
            self.users -= 1
            timer = threading.Timer(IDLE_SECONDS, self.rest, [self.turn])
        timer.daemon = True
        timer.start()

    def rest(self, turn: int) -> None:
        with self.lock:
            if not self.users and turn == self.turn:
                self.kept, self.older = {}, {}

    def piece(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_CHARS:
            self.kept[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(self.kept) >= KEPT_PIECES:  # pieces not met again since the last turn go
            self.older, self.kept = self.kept, {}
        get, piece = self.kept.get, self.piece
        found = self.find_ascii(text) if text.isascii() else self.find(text)
        return b"".join([get(p) or piece(p) for p in found])


#: The encoder of the last broadcast a worker has met: its pieces serve the next tasks too.
_last: list[tuple[object, Encoder]] = []


def _encoder(shared) -> Encoder:
    if not _last or _last[0][0] is not shared:
        _last[:] = [(shared, Encoder(*shared.value))]
    return _last[0][1]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as a binary column of little-endian 32-bit integers
    (``unpack_ids`` makes an array of it). A column that has that name already is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kept = [f for f in docs.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as encoder:
            for batch in batches:
                ids = [encoder.encode(t) if t else b"" for t in (x.as_py() for x in batch.column(text_col))]
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.binary())], names=[*names, out_col])

    return docs.mapInArrow(run, _schema(kept, f"`{out_col}` binary"))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``docs`` with the bytes that packed ids stand for. Null ids give empty bytes; an id that no token
    has is an error."""
    shared = docs.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    kept = [f for f in docs.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, memoryview(x).cast("I"))) if x else b"" for x in (v.as_py() for v in batch.column(ids_col))]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, out_col])

    return docs.mapInArrow(run, _schema(kept, f"`{out_col}` binary"))


def _schema(kept, more: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept), more])


def unpack_ids(packed):
    """Packed ids as an array of bigint."""
    digits = F.hex(packed)
    count = (F.length(packed) / 4).cast("int")

    def number(i):
        at = i * 8 + 1
        parts = [F.substr(digits, at + 2 * b, F.lit(2)) for b in (3, 2, 1, 0)]
        return F.conv(F.concat(*parts), 16, 10).cast("bigint")

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).otherwise(F.array().cast("array<bigint>"))


def token_report(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, and decoded_sha256 of what the ids decode to. A text is encoded and its
    ids are decoded by the same worker, so ids go nowhere."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as encoder:
            token = encoder.tokens.__getitem__
            for batch in batches:
                counts, ids_sha, bytes_sha = [], [], []
                for text in batch.column("text"):
                    ids = encoder.encode(text.as_py() or "")
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    bytes_sha.append(hashlib.sha256(b"".join(map(token, memoryview(ids).cast("I")))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.mapInArrow(run, _schema([docs.schema["doc_id"]], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
