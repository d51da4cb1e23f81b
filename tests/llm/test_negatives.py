import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, is_anchor, positives=5, k=5, low=80, high=100):
    ok = [(i, tuple(x), y) for i, x, y in rows if i is not None and x is not None and y is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, q, label in {r for r in ok if is_anchor(r[0])}:
        scored = [(sum(x * y for x, y in zip(q, v, strict=True)), i, y) for i, v, y in ok if len(v) == len(q) and i != a]
        best = sorted((r for r in scored if r[2] == label), key=lambda r: (-r[0], r[1]))[:positives]
        for p, pid, _ in best:
            hard = sorted((r for r in scored if r[2] != label and low * p <= 100 * r[0] <= high * p), key=lambda r: (-r[0], r[1]))[:k]
            out += [(a, pid, rank + 1, n, p, s) for rank, (s, n, _) in enumerate(hard)]
    return sorted(out)


def ours(spark, rows, modulo, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.mine(negatives.usable(df), F.col("id") % modulo == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def made(seed, n=400, dim=6, scale=9):
    """Vectors of many lengths, close groups, one vector that a third of the rows hold, ties."""
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(dim)] for _ in range(5)]
    hot = [float(round(x)) for x in centres[0]]
    rows = []
    for i in range(n):
        if r.random() < 0.33:
            v = hot
        elif r.random() < 0.5:
            v = [float(round(x * f + r.gauss(0, 1))) for f in [r.choice([0.1, 1, 1, 3])] for x in r.choice(centres)]
        else:
            v = [float(r.randrange(-9, 10)) for _ in range(dim)]
        rows.append((i, list(v), r.randrange(4)))
    rows += [(n, None, 1), (None, hot, 1), (n + 1, hot, None), (n + 2, [*hot[:-1], float("nan")], 1), (n + 3, [*hot[:-1], float("inf")], 2)]
    rows += [(n + 4, [*hot[:-1], None], 1), (n + 5, hot[:3], 1), (n + 6, hot[:3], 2), (n + 7, [], 1), (n + 8, [0.0] * dim, 2), rows[3], rows[20], rows[20]]
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"bucket": 16, "block": 16}), (3, {"bucket": 50, "positives": 3, "negatives": 2, "low": 50, "high": 90})])
def test_equal_to_plain_search(spark, seed, options):
    rows = made(seed)
    bounds = {"positives": options.get("positives", 5), "k": options.get("negatives", 5), "low": options.get("low", 80), "high": options.get("high", 100)}
    want = plain(rows, lambda i: i % 10 == 0, **bounds)
    assert ours(spark, rows, 10, **options) == want and len(want) > 100


def test_anchors_of_one_id_and_equal_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)]
    rows += [(10 + i, [1.0, 1.0], 2) for i in range(8)] + [(30, [-1.0, -1.0], 3)]
    assert ours(spark, rows, 100) == plain(rows, lambda i: i % 100 == 0)
    assert ours(spark, [(0, [0.0, 0.0], 1), (1, [1.0, 2.0], 1), (2, [3.0, 4.0], 2)], 100) == [(0, 1, 1, 2, 0.0, 0.0)]


def test_pruning_keeps_every_row_that_may_count():
    r = np.random.default_rng(4)
    vectors = np.concatenate([r.integers(-50, 51, (300, 8)), np.repeat(r.integers(-50, 51, (2, 8)), 150, axis=0)]).astype(float)
    packed = negatives._packed(np.arange(600), np.zeros(600, np.int64), vectors)
    bucket = negatives.Bucket.read(dict(zip((x.split()[0] for x in negatives.BUCKETS.split(", ")), packed, strict=True)))
    anchors = np.concatenate([vectors[r.choice(300, 20)], vectors[[300, 450]]])
    exact = vectors @ anchors.T
    pruned = 0
    for share in (0.0, 0.3, 0.9, 0.999, 1.0, 1.5):
        theta = share * exact.max(axis=0)
        got = bucket.scores(anchors, theta)
        needed = exact >= theta
        assert (got[needed] == exact[needed]).all() and np.isin(got[~needed], [-np.inf, *exact[~needed].tolist()]).all()
        pruned += (got == -np.inf).sum()
    assert pruned > 0.3 * exact.size


def test_empty_tables(spark):
    assert ours(spark, [], 10) == []
    assert ours(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == []
    df = spark.createDataFrame([(0, [0.5], 1, "x", 2)], "vec_id bigint, embedding array<float>, label int, id string, vector int")
    assert negatives.negatives_report(df).collect() == []


def test_report_on_a_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, [float(np.floor(np.float64(x) * 256)) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    got = sorted(tuple(r) for r in negatives.negatives_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect())
    want = plain(moved, lambda i: i % 100 == 0)
    assert got == want
    by = defaultdict(list)
    for a, p, rank, *_ in want:
        by[a, p].append(rank)
    assert all(r == list(range(1, len(r) + 1)) for r in by.values())
