"""The guard of a stream against a plain walk over the arrivals, over many batches and a restart."""

import random
from datetime import datetime, timedelta

import pytest

from sheaf.streaming.guard import guard_sources, rocks_state
from sheaf.streaming.pack_stream import start_append

START, WINDOW = datetime(2024, 3, 1), timedelta(minutes=30)
IN = "bundle_id string, path string, source string, at timestamp, more string"


@pytest.fixture
def rocks(spark):
    with rocks_state(spark):
        yield spark


def plain(batches, window=WINDOW):
    first, out = {}, []
    for batch in batches:
        for b, p, s, at in sorted((r[:4] for r in batch if r[3]), key=lambda r: (r[3], r[2] is not None, r[2] or "")):
            kept = (b, p) not in first or at - first[b, p][0] >= window
            if kept:
                first[b, p] = (at, s)
            out.append((b, p, s, at, kept, first[b, p][1], first[b, p][0]))
    return sorted(out, key=repr)


def arrive(spark, tmp_path, batch):
    spark.createDataFrame(batch, IN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, lateness="1 hour"):
    stream = spark.readStream.schema(IN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_append(guard_sources(stream, WINDOW, lateness), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    return query, sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def test_equal_to_a_plain_walk_over_batches_and_a_restart(rocks, tmp_path):
    r = random.Random(3)
    batches = [
        [(r.choice(["a", "b", None]), r.choice(["x", "y/z", None]), r.choice(["s1", "s2", None]), START + timedelta(seconds=1200 * k + r.randrange(1200)), "m") for _ in range(25)]
        for k in range(5)
    ]
    batches[1] += [("a", "x", "s9", None, "no time")]
    tie = START + timedelta(hours=3)
    batches.append([("t", "tie", s, tie, "m") for s in ("s2", "s1", "s1", None)] + [("t", "tie", "s0", tie + WINDOW - timedelta(microseconds=1), "m"), ("t", "tie", "s5", tie + WINDOW, "m")])
    for batch in batches[:3]:
        arrive(rocks, tmp_path, batch)
    assert run(rocks, tmp_path)[1] == plain(batches[:3])
    for batch in batches[3:]:  # state comes back from the checkpoint
        arrive(rocks, tmp_path, batch)
    assert run(rocks, tmp_path)[1] == plain(batches)


def test_state_goes_and_late_rows_are_dropped(rocks, tmp_path):
    rows = [[("a", f"p{i}", "s", START + timedelta(hours=3 * k, seconds=i), "m") for i in range(5)] for k in range(3)]
    rows += [[("a", "late", "s", START, "m"), ("a", "p0", "s", START + timedelta(hours=6, minutes=1), "m")]]
    for batch in rows:
        arrive(rocks, tmp_path, batch)
    query, got = run(rocks, tmp_path)
    assert got == plain([*rows[:3], rows[3][1:]])
    assert not [x for x in got if x[1] == "late"]
    assert query.lastProgress.stateOperators[0].numRowsTotal < 60  # 15 windows were opened, 5 are open


def test_an_empty_stream(rocks, tmp_path):
    arrive(rocks, tmp_path, [])
    assert run(rocks, tmp_path)[1] == []
