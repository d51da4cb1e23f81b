"""Hard-negative mining by inner product, with LEMP-style buckets and coordinate pruning.

Rows have an id, a vector and a label. For an anchor, its positives are the ``positives`` best other rows of its
label; for each positive with score ``p`` the ``negatives`` best rows of other labels with a score ``n`` where
``low * p <= 100 * n <= high * p`` are the hard negatives. Higher scores come first, ties by smaller id.

Index: rows are range-partitioned by length of vector and cut into buckets of at most ``BUCKET`` rows, longest first.
A bucket keeps its vectors and, per coordinate, the order of its rows by that coordinate of the vector scaled to length
one: the sorted list. Buckets are written once to the shared folder.

Search: anchors are the stated query set. They are broadcast in blocks of at most ``ANCHORS`` and every task goes through its buckets,
with the best scores so far of every anchor. A row that could still count needs a score of ``theta`` at least, so

* a bucket whose longest vector times the anchor is below ``theta`` is passed over,
* else the cosine has to be ``t = theta / (anchor * longest)`` or more. For the anchor's ``FOCUS`` largest coordinates ``q`` that
  leaves the range ``q * t -+ sqrt((1 - q * q) * (1 - t * t))``, a stretch of the sorted list. The shortest
  stretch is taken and cut down to the rows within the other ranges; these candidates are verified exactly,
* where ranges rule out less than half of a bucket, all of it is verified by one product of matrices.

A task gives at most ``positives`` rows an anchor, or ``negatives`` rows a positive, however many rows tie; a ranked window over tasks
then decides. Positives are found first, then negatives, two passes over the buckets for each block of anchors.

Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of another dimension
than an anchor's, and rows with an anchor's id, are none of its partners. Repeated rows count one by one, but equal
anchors are one; anchors of one id with different vectors or labels are served one by one. An anchor without positives has no
rows. Vectors without components have score 0. Scores are sums of doubles, exact for whole components as
long as sums stay below 2**53. Other columns are not read. Empty tables give an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import shared_dir

BUCKET = 4096
ANCHORS = 20_000
CHUNK = 512
FOCUS = 3
_SLACK = 1e-6

BUCKETS = "dim int, n int, longest double, ids binary, labels binary, kind string, vectors binary, lists binary"


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, vector`` of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("vector"), bad.alias("bad"))
    return kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.col("bad")).drop("bad")


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple:
    """A bucket as a row: vectors in the smallest type that holds them, sorted lists as 16-bit row numbers."""
    by = np.argsort(ids, kind="stable")
    ids, labels, vectors = ids[by], labels[by], vectors[by]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    lists = np.argsort(vectors / np.maximum(length, 1e-300)[:, None], axis=0, kind="stable").T.astype(np.uint16)
    kind = next((k for k in ("int16", "int32") if (vectors.astype(k).astype(np.float64) == vectors).all()), "float64") if np.abs(vectors).max(initial=0) < 2**31 else "float64"
    return vectors.shape[1], len(ids), float(length.max(initial=0)), ids.tobytes(), labels.tobytes(), kind, vectors.astype(kind).tobytes(), lists.tobytes()


def build_buckets(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (``id, label, vector``) as a table of buckets, written to the shared folder."""
    if not 1 <= bucket <= 1 << 16:
        raise ValueError("a bucket has 1 to 65536 rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten(), dtype=np.float64)
            at = np.cumsum(size) - size
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            out = []
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                for lo in range(0, len(own), bucket):
                    part = own[lo : lo + bucket]
                    out.append(_packed(ids[part], labels[part], flat[at[part][:, None] + np.arange(dim)]))
            for row in out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

    names = [x.split()[0] for x in BUCKETS.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BUCKETS.split(", ")])
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    ranged = rows.withColumn("length", length).repartitionByRange(F.size("vector"), F.col("length").desc(), "id")
    ranged = ranged.sortWithinPartitions(F.size("vector"), F.col("length").desc()).select("id", "label", "vector")
    where = shared_dir(rows.sparkSession, "buckets")
    ranged.mapInArrow(run, BUCKETS).write.parquet(where)
    return rows.sparkSession.read.parquet(where)


@dataclass
class Bucket:
    """Rows of one dimension, by id, with the sorted list of every coordinate."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    longest: float
    lists: np.ndarray

    @staticmethod
    def read(row: dict) -> Bucket:
        n, dim = row["n"], row["dim"]
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, dim).astype(np.float64)
        return Bucket(
            np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors, row["longest"], np.frombuffer(row["lists"], np.uint16).reshape(dim, n)
        )

    def scaled(self) -> np.ndarray:
        return self.vectors / np.maximum(np.sqrt((self.vectors**2).sum(axis=1)), 1e-300)[:, None]

    def candidates(self, anchors: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Anchors that need all rows verified, and for others the rows that may reach ``theta``. Those in neither
        have none."""
        n, dim = self.vectors.shape
        length = np.sqrt((anchors**2).sum(axis=1))
        most = length * self.longest
        alive = theta <= most * (1 + _SLACK) + _SLACK
        t = np.where((theta > 0) & (most > 0), theta / np.where(most > 0, most, 1), -1.0) - _SLACK
        whole = alive & (t <= 0)
        some: dict[int, np.ndarray] = {}
        pruned = np.flatnonzero(alive & (t > 0))
        if not len(pruned):
            return np.flatnonzero(whole), some
        t = np.minimum(t, 1.0)
        unit = anchors / np.where(length > 0, length, 1)[:, None]
        focus = np.argsort(-np.abs(unit[pruned]), axis=1, kind="stable")[:, :FOCUS]
        q = np.take_along_axis(unit[pruned], focus, axis=1)
        level = t[pruned][:, None]
        wide = np.sqrt(np.maximum((1 - q * q) * (1 - level * level), 0))
        low = np.where(q < -level, -1.0, q * level - wide) - _SLACK
        high = np.where(q > level, 1.0, q * level + wide) + _SLACK
        scaled = self.scaled()
        begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus).tolist():
            values = scaled[self.lists[f], f]
            own = focus == f
            begin[own] = np.searchsorted(values, low[own])
            end[own] = np.searchsorted(values, high[own], side="right")
        short = (end - begin).argmin(axis=1)
        for k, a in enumerate(pruned.tolist()):
            s = short[k]
            if 2 * (end[k, s] - begin[k, s]) > n:
                whole[a] = True
                continue
            rows = self.lists[focus[k, s], begin[k, s] : end[k, s]].astype(np.int64)
            for j in range(focus.shape[1]):
                if j != s:
                    x = scaled[rows, focus[k, j]]
                    rows = rows[(x >= low[k, j]) & (x <= high[k, j])]
            if len(rows):
                some[a] = np.sort(rows)
        return np.flatnonzero(whole), some

    def scores(self, anchors: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Rows by anchors: inner products, minus infinity where a score below ``theta`` was ruled out."""
        out = np.full((len(self.ids), len(anchors)), -np.inf)
        whole, some = self.candidates(anchors, theta)
        if len(whole):
            out[:, whole] = self.vectors @ anchors[whole].T
        for a, rows in some.items():
            out[rows, a] = self.vectors[rows] @ anchors[a]
        return out


@dataclass
class Best:
    """The best scores and ids of every query so far, best first; minus infinity marks a free place."""

    score: np.ndarray
    ids: np.ndarray

    @staticmethod
    def empty(queries: int, k: int) -> Best:
        return Best(np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64))

    def take(self, own: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in the columns of ``scores`` (rows by queries, which it uses up); ``ids`` ascend."""
        k = self.score.shape[1]
        at = np.arange(scores.shape[1])
        new_score, new_id = [self.score[own]], [self.ids[own]]
        for _ in range(min(k, len(ids))):
            top = scores.argmax(axis=0)  # the first of equal ones, so the smallest id
            best = scores[top, at]
            if not (best > -np.inf).any():
                break
            new_score.append(best[:, None])
            new_id.append(ids[top][:, None])
            scores[top, at] = -np.inf
        score, ids = np.concatenate(new_score, axis=1), np.concatenate(new_id, axis=1)
        by = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[own], self.ids[own] = np.take_along_axis(score, by, axis=1), np.take_along_axis(ids, by, axis=1)


@dataclass
class Block:
    """A block of anchors of one dimension; ``first`` numbers them. ``scores`` are those of positives, nan if fewer."""

    first: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray | None = None


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Bucket.read(batch.slice(k, 1).to_pylist()[0])


def _chunks(n: int) -> Iterator[slice]:
    for lo in range(0, n, CHUNK):
        yield slice(lo, min(lo + CHUNK, n))


def _rows(anchor: np.ndarray, best: Best, **more: np.ndarray) -> pa.RecordBatch:
    full = best.score > -np.inf
    which = np.nonzero(full)[0]
    columns = {"anchor": anchor[which], **{k: v[which] for k, v in more.items()}, "score": best.score[full], "id": best.ids[full]}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=[*columns])


def _find_positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = shared.value
        best = [Best.empty(len(b.ids), k) for b in blocks]
        for bucket in _buckets(batches):
            for block, top in zip(blocks, best, strict=True):
                if block.vectors.shape[1] != bucket.vectors.shape[1]:
                    continue
                for own in _chunks(len(block.ids)):
                    s = bucket.scores(block.vectors[own], top.score[own, -1])
                    s[(bucket.labels[:, None] != block.labels[own]) | (bucket.ids[:, None] == block.ids[own])] = -np.inf
                    top.take(own, s, bucket.ids)
        for block, top in zip(blocks, best, strict=True):
            yield _rows(block.first + np.arange(len(block.ids)), top)

    return run


def _find_negatives(shared, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = shared.value
        best = [[Best.empty(len(b.ids), k) for _ in range(b.scores.shape[1])] for b in blocks]
        for bucket in _buckets(batches):
            for block, tops in zip(blocks, best, strict=True):
                if block.vectors.shape[1] != bucket.vectors.shape[1]:
                    continue
                for own in _chunks(len(block.ids)):
                    least = np.full(own.stop - own.start, np.inf)
                    for slot, top in enumerate(tops):
                        p = block.scores[own, slot]
                        need = np.where(low * p <= high * p, np.maximum(low * p / 100, top.score[own, -1]), np.inf)
                        least = np.fmin(least, np.where(np.isnan(p), np.inf, need))
                    s = bucket.scores(block.vectors[own], least)
                    s[(bucket.labels[:, None] == block.labels[own]) | (bucket.ids[:, None] == block.ids[own])] = -np.inf
                    if not (s > -np.inf).any():
                        continue
                    for slot, top in enumerate(tops):
                        p = block.scores[own, slot]
                        if not np.isnan(p).all():
                            top.take(own, np.where((100 * s >= low * p) & (100 * s <= high * p), s, -np.inf), bucket.ids)
        for block, tops in zip(blocks, best, strict=True):
            for slot, top in enumerate(tops):
                yield _rows(block.first + np.arange(len(block.ids)), top, positive=block.scores[:, slot])

    return run


def _blocks(buckets: DataFrame, most: int) -> Iterator[list[Block]]:
    """Anchors in blocks of at most ``most``, or one bucket; they come to the driver block by block."""
    blocks: list[Block] = []
    first = size = 0
    for row in buckets.toLocalIterator():
        b = Bucket.read(row.asDict())
        if blocks and size + len(b.ids) > most:
            yield blocks
            blocks, size = [], 0
        blocks.append(Block(first, b.ids, b.labels, b.vectors))
        first, size = first + len(b.ids), size + len(b.ids)
    if blocks:
        yield blocks


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of every key over all tasks, numbered."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, bucket: int = BUCKET, block: int = ANCHORS
) -> DataFrame:
    """Hard negatives of ``rows`` (``id, label, vector``, see ``usable``) for those where ``is_anchor`` holds.

    Per anchor, positive and rank: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    index = build_buckets(rows, bucket)
    queries = build_buckets(rows.filter(is_anchor).distinct(), min(bucket, block))
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score double, negative_score double")
    for blocks in _blocks(queries, block):
        shared = spark.sparkContext.broadcast(blocks)
        found = index.mapInArrow(_find_positives(shared, positives), "anchor bigint, score double, id bigint")
        where = shared_dir(spark, "positives")
        _ranked(found, ["anchor"], positives).write.parquet(where)
        known = spark.read.parquet(where)
        held = known.select("anchor", "rank", "score").toPandas()  # a block's anchors times ``positives`` at most
        first = blocks[0].first
        scores = np.full((sum(len(b.ids) for b in blocks), positives), np.nan)
        scores[held["anchor"].to_numpy() - first, held["rank"].to_numpy() - 1] = held["score"].to_numpy()
        # of equal positive scores one is searched; all take its negatives
        scores[:, 1:][scores[:, 1:] == scores[:, :-1]] = np.nan
        for b in blocks:
            b.scores = scores[b.first - first : b.first - first + len(b.ids)]
        shared = spark.sparkContext.broadcast(blocks)
        found = index.mapInArrow(_find_negatives(shared, negatives, low, high), "anchor bigint, positive double, score double, id bigint")
        hard = _ranked(found, ["anchor", "positive"], negatives)
        ids = [(b.first + i, x) for b in blocks for i, x in enumerate(b.ids.tolist())]
        names = spark.createDataFrame(ids, "anchor bigint, anchor_id bigint")
        pairs = known.join(names, "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive"))
        where = shared_dir(spark, "negatives")
        hard.join(pairs, ["anchor", "positive"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score")
        ).write.parquet(where)
        out = out.unionByName(spark.read.parquet(where))
    return out


def negatives_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives over ``vec_id, embedding, label``: components become ``floor(256 * x)``, labels of ids divisible by seven
    move on by one of ten, ids divisible by 100 are anchors."""
    rows = usable(vectors).withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256).cast("double")))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = mine(rows, F.col("id") % 100 == 0)
    return found.withColumns({n: F.col(n).cast("bigint") for n in ("positive_score", "negative_score")})
