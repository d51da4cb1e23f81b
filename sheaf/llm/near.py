"""Near-duplicate classes from band hashes: candidates, exact verification, union-find.

A node is a distinct text, named by 128 bits of its content (``a, b``). Its bands are 64-bit hashes;
nodes that share one are candidates. Every step is a join or an aggregate, none gathers a bucket:

1. Hashes that occur once are dropped: they are counted with partial sums and joined back.
2. In each bucket one node is the hub, the one whose buckets are largest in sum (the middle of a group
   of copies lies in most of its buckets). Every other member is compared with the hub exactly. That is
   one pair a member, whatever the size of the bucket.
3. Links are folded into components (alternating large and small stars).
4. What the hubs leave: in a bucket that still holds more than one component, members of different
   components are compared, all of them, in blocks of about ``BLOCK`` members. A block pair yields at
   most a spanning forest of links, so rows out never grow with the square of a bucket. Components are
   then folded again.

So components are those of all verified pairs within buckets; no bucket has a cap. Content is only moved
for nodes with a candidate: a bitmap of fixed size tells which, and lets too many pass when it fills up,
never too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import shared_dir

BLOCK = 256
#: Bytes of contents of small block pairs that are read at a time.
READ_BYTES = 1 << 18
FILTER_WORDS = 1 << 19

#: A set: sorted unique 64-bit ids and their weights.
Weighted = tuple[np.ndarray, np.ndarray]
#: Reads contents into sets.
Reader = Callable[[list[bytes]], list[Weighted]]


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: work before it is never done again, even if executors are lost."""
    where = shared_dir(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``h, a, b, size`` of every band hash that two nodes or more hold. ``a, b, bands`` may repeat.

    Of buckets with the very same members one is enough.
    """
    rows = nodes.select("a", "b", F.explode("bands").alias("h"))
    often = rows.groupBy("h").count().filter("count > 1").select("h")
    held = written(rows.join(often.hint("shuffle_hash"), "h").distinct(), "members")
    name = [F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")).alias(f"n{seed}") for seed in (1, 2)]
    shared = held.groupBy("h").agg(F.count("*").alias("size"), *name).filter("size > 1")
    shared = shared.groupBy("size", "n1", "n2").agg(F.min("h").alias("h")).select("h", "size")
    return held.join(shared.hint("shuffle_hash"), "h").select("h", "a", "b", "size")


def with_hubs(members: DataFrame) -> DataFrame:
    """``members`` with the hub of each bucket, ``pa, pb``."""
    weight = members.groupBy("a", "b").agg(F.sum("size").alias("weight"))
    ranked = members.join(weight, ["a", "b"])
    hubs = ranked.groupBy("h").agg(F.max(F.struct("weight", "a", "b")).alias("hub"))
    return members.join(hubs, "h").select("h", "a", "b", "size", F.col("hub.a").alias("pa"), F.col("hub.b").alias("pb"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """``a, b, pa, pb``: every member beside the hub of each of its buckets, once."""
    return members.select("a", "b", "pa", "pb").filter("a != pa or b != pb").distinct()


class Filter:
    """A bitmap over the names of nodes, of fixed size."""

    def __init__(self, nodes: DataFrame) -> None:
        cell = F.col("a").bitwiseAND(FILTER_WORDS * 64 - 1)
        rows = nodes.groupBy(F.shiftright(cell, 6).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(a & {63} as int))")).alias("bits")
        )
        found = rows.toArrow()  # FILTER_WORDS rows at most
        self.words = np.zeros(FILTER_WORDS, np.int64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def __call__(self, a: np.ndarray) -> np.ndarray:
        return self.words[(a & (FILTER_WORDS * 64 - 1)) >> 6] >> (a & 63) & 1 == 1


def jaccard(x: Weighted, y: Weighted) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    at = np.searchsorted(x[0], y[0])
    at[at == len(x[0])] = 0
    both = x[0][at] == y[0]
    least = float(np.minimum(x[1][at[both]], y[1][both]).sum())
    total = float(x[1].sum()) + float(y[1].sum()) - least
    return least / total if total else 0.0


def verified_pairs(pairs: DataFrame, content: DataFrame, read: Reader, threshold: float) -> DataFrame:
    """The pairs whose contents are similar enough."""
    left = content.select("a", "b", F.col("content").alias("x"))
    right = content.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("content").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hubs = part.column("y").dictionary_encode()
                known, own = read(hubs.dictionary.to_pylist()), hubs.indices.to_pylist()
                sets = read(part.column("x").to_pylist())
                keep = [jaccard(x, known[i]) >= threshold for x, i in zip(sets, own, strict=True)]
                yield part.select(["a", "b", "pa", "pb"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, ["a", "b"]).join(right, ["pa", "pb"])
    return both.select("a", "b", "pa", "pb", "x", "y").mapInArrow(run, "a bigint, b bigint, pa bigint, pb bigint")


def rest_links(members: DataFrame, labels: DataFrame, content: DataFrame, read: Reader, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links between different components that still share a bucket. Hubs have been compared with all."""
    others = members.filter("a != pa or b != pb")
    named = others.join(labels, ["a", "b"], "left").select(
        "h", "a", "b", "size", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")
    )
    open_ = named.groupBy("h").agg(
        F.min("la").alias("x"), F.max("la").alias("y"), F.min("lb").alias("z"), F.max("lb").alias("w")
    ).filter("x != y or z != w").select("h")
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = (
        named.join(open_.hint("shuffle_hash"), "h")
        .withColumn("n", blocks)
        .withColumn("own", F.pmod(F.xxhash64("a", "b", "h"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "b", "la", "lb")
        .join(content, ["a", "b"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sets in _read_groups(_groups(batches), read):
            x, y = _links(group, sets, threshold)
            if len(x):
                a, b = group.column("a"), group.column("b")
                x, y = pa.array(x), pa.array(y)
                yield pa.RecordBatch.from_arrays([a.take(x), b.take(x), a.take(y), b.take(y)], names=["a", "b", "pa", "pb"])

    dealt = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint, pa bigint, pb bigint").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block pairs of a sorted partition, one after the other; only one is held beside a batch."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("h", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            name = tuple(keys[lo].tolist())
            if open_ and name != last:
                yield pa.concat_batches(open_)
                open_ = []
            last = name
            open_.append(batch.slice(lo, hi - lo))
    if open_:
        yield pa.concat_batches(open_)


def _read_groups(groups: Iterator[pa.RecordBatch], read: Reader) -> Iterator[tuple[pa.RecordBatch, list[Weighted]]]:
    """Block pairs of several components with their sets; small ones are read together, ``READ_BYTES`` at a time."""
    held: list[pa.RecordBatch] = []
    contents: list[bytes] = []
    size = 0
    for group in groups:
        la, lb = group.column("la").to_numpy(), group.column("lb").to_numpy()
        if (la == la[0]).all() and (lb == lb[0]).all():
            continue
        held.append(group)
        contents += group.column("content").to_pylist()
        size += group.column("content").nbytes
        if size >= READ_BYTES:
            yield from _with_sets(held, read(contents))
            held, contents, size = [], [], 0
    if held:
        yield from _with_sets(held, read(contents))


def _with_sets(groups: list[pa.RecordBatch], sets: list[Weighted]) -> Iterator[tuple[pa.RecordBatch, list[Weighted]]]:
    at = 0
    for group in groups:
        yield group, sets[at : at + group.num_rows]
        at += group.num_rows


def _links(group: pa.RecordBatch, sets: list[Weighted], threshold: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the similar pairs of one block pair, between different components."""
    la, lb, own = (group.column(c).to_numpy() for c in ("la", "lb", "own"))
    names: dict[tuple[int, int], int] = {}
    label = np.array([names.setdefault(x, len(names)) for x in zip(la.tolist(), lb.tolist(), strict=True)])
    least = _least_sums(sets) if len(sets) > 3 else None
    total = np.array([float(s[1].sum()) for s in sets])
    differ = label[:, None] != label[None, :]
    if (own != own[0]).any():  # a pair within a block is compared where both blocks are the same
        differ &= own[:, None] != own[None, :]
    if least is None:
        fit = np.array([[i < j and differ[i, j] and jaccard(sets[i], sets[j]) >= threshold for j in range(len(sets))] for i in range(len(sets))])
    else:
        most = total[:, None] + total[None, :] - least
        fit = np.triu((least >= threshold * most) & (most > 0) & differ, 1)
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    for x, y in np.argwhere(fit).tolist():
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return [x for x, _ in out], [y for _, y in out]


def _least_sums(sets: list[Weighted]) -> np.ndarray:
    """Sums of minima of all pairs of weighted sets."""
    n = len(sets)
    ids = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets])
    who = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    known, column, held = np.unique(ids, return_inverse=True, return_counts=True)
    rank = np.cumsum(held > 1) - 1  # only ids of two sets or more matter
    keep = held[column] > 1
    column, weight, who = rank[column[keep]], weight[keep], who[keep]
    order = np.argsort(column)
    column, weight, who = column[order], weight[order], who[order]
    out = np.zeros((n, n))
    for lo in range(0, int((held > 1).sum()), 4096):
        i, j = np.searchsorted(column, (lo, lo + 4096))
        table = np.zeros((n, int(column[j - 1]) - lo + 1), np.float32)
        table[who[i:j], column[i:j] - lo] = weight[i:j]
        top = table.max(axis=0)
        same = ((table == 0) | (table == top)).all(axis=0)
        flat = (table[:, same] > 0) * np.sqrt(top[same])
        out += flat @ flat.T
        for row in range(n) if not same.all() else ():
            out[row] += np.minimum(table[:, ~same], table[row, ~same]).sum(axis=1)
    return out


def components(links: DataFrame) -> DataFrame:
    """``a, b, la, lb``: every node with a link, and the least node of its component.

    Large and small stars in turn: each node hands its neighbours to the least of them. A hub of any
    degree is an aggregate and a join, so no neighbourhood is gathered. Every round is a table.
    """
    u, v = F.struct("a", "b"), F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct()
    edges = written(edges, "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "stars")
        # Stars are done: every node below has one link, and none hangs on another. An edge leads to a lesser node.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below")).union(edges.select(F.col("v").alias("x"), F.lit(0)))
        seen = ends.groupBy("x").agg(F.sum("below").alias("links"), F.min("below").alias("least"))
        if seen.filter("links > 1 or (links = 1 and least = 0)").isEmpty():
            break
    own = edges.select("v").distinct().select(F.col("v").alias("u"), "v")
    return edges.union(own).select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), F.col("v.a").alias("la"), F.col("v.b").alias("lb"))


def near_classes(
    spark: SparkSession,
    nodes: DataFrame,
    contents: Callable[[Filter], DataFrame],
    read: Reader,
    threshold: float,
    block: int = BLOCK,
) -> DataFrame:
    """``a, b, la, lb`` of every node that a chain of similar nodes ties to another.

    ``nodes`` has ``a, b, bands`` and may repeat a node. ``contents`` yields ``a, b, content`` of all nodes that the
    filter lets pass; it may repeat a node.
    """
    members = written(with_hubs(bucket_members(nodes)), "hubs")
    content = contents(Filter(members)).groupBy("a", "b").agg(F.first("content").alias("content"))
    content = written(content, "contents")
    links = written(verified_pairs(hub_pairs(members), content, read, threshold), "links")
    labels = written(components(links), "labels")
    rest = written(rest_links(members, labels, content, read, threshold, block), "links")
    if rest.isEmpty():
        return labels
    # The stars found so far hold all that the first links tell.
    stars = labels.select("a", "b", F.col("la").alias("pa"), F.col("lb").alias("pb"))
    return written(components(stars.union(rest)), "labels")


def split_rows(docs: DataFrame, wanted: Filter) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the name of the text (``__a, __b``), in two parts: rows the filter lets pass, and
    rows that surely are not wanted. Only the first part has to be moved to be joined."""
    named = docs.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.xxhash64(F.lit("second"), F.col("text")))

    def part(passes: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(wanted(batch.column("__a").to_numpy()) == passes))

        return named.mapInArrow(run, named.schema)

    return part(True), part(False)


def one_of_equals(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with one row for each ``doc_id, __a, __b`` that ``repeated`` lists in three columns."""
    if repeated.isEmpty():
        return rows
    repeated = repeated.toDF("__doc", "__t1", "__t2")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.expr("__a = __t1 and __b = __t2")
    single = rows.join(repeated, same, "left_anti")
    return single.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__a", "__b"]))
