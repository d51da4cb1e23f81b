"""Raw trees, several sources, streams and progress."""

import os

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sheaf.functions.globs import Rule, default_rules, parse_rules
from sheaf.operators.exclude import exclude_filter
from sheaf.plans.pack import pack, pack_sources, pack_tree
from sheaf.session import arrow_batches, shared_dir
from sheaf.sources import files
from sheaf.sources.files import list_tree, read_files, scan_sources, scan_tree, union_sources
from sheaf.sources.bundles import read_bundle, write_bundle
from sheaf.streaming.pack_stream import drain, guard_duplicates, pack_arrivals, start_append
from sheaf.streaming.progress import observe_pack


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a.txt": b"one\n", "empty.txt": b"", "_under.txt": b"u", ".hidden": b"h", "d/e/f.txt": b"deep",
        "d/skip.log": b"l", "d/bin.dat": b"\0\1", "__pycache__/x": b"c",
    }
    for name, data in files.items():
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "tree" / "a.txt", tmp_path / "tree" / "link.txt")
    return tmp_path / "tree", files


def test_tree_scan_keeps_empty_and_marked_names(spark, tree):
    root, files = tree
    got = {r.path: bytes(r.content) for r in scan_tree(spark, str(root)).collect()}
    assert got == files
    ruled = scan_tree(spark, str(root), default_rules() + [Rule("*.log")])
    assert {r.path for r in ruled.collect()} == {"a.txt", "empty.txt", "_under.txt", "d/e/f.txt", "d/bin.dat"}
    assert all(r.length == len(files[r.path]) for r in ruled.collect())


def test_workers_hold_little(spark, monkeypatch, tmp_path):
    """Written and read in small batches, whatever the number of rows; a row is never cut."""
    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    with arrow_batches(spark, 100_000):
        small = [r.n for r in texts.mapInPandas(sizes, "n int").collect()]
    assert sum(small) == 300 and max(small) <= 12
    assert [r.n for r in texts.mapInPandas(sizes, "n int").collect()] == [300]  # the setting is as it was
    seen = []
    monkeypatch.setattr(files, "READ_BATCH_BYTES", 4_000)
    (tmp_path / "big").write_bytes(b"y" * 9_000)
    for i in range(20):
        (tmp_path / str(i)).write_bytes(bytes([i]) * 900)
    batch = pd.DataFrame({"path": ["big", *map(str, range(20)), "gone"]})
    for part in files.parts_read(str(tmp_path), "content", -1)(batch):
        seen += part.values.tolist()
        assert sum(len(x or b"") for x in part["content"]) < 4_900 or part["path"].tolist() == ["big"]
    assert seen == [["big", b"y" * 9_000], *([str(i), bytes([i]) * 900] for i in range(20)), ["gone", None]]


def test_excluded_folders_are_not_opened(spark, tmp_path):
    for name in ("a/x.txt", "a/build/y.txt", "a/build/keep/z.md", "node_modules/p/q.js", "node_modules/keep.md", "c/.git/h", "c/d/e.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rules = default_rules() + parse_rules("*.log\n!/a/build/keep/*.md")
    every = list_tree(spark, str(tmp_path))
    walked = list_tree(spark, str(tmp_path), rules)
    assert {r.path for r in walked.collect()} == {"a/x.txt", "a/build/y.txt", "a/build/keep/z.md", "c/d/e.log"}
    kept = lambda df: sorted(r.path for r in exclude_filter(df, rules).collect())
    assert kept(walked) == kept(every) == ["a/build/keep/z.md", "a/x.txt"]
    assert sorted(r.path for r in scan_tree(spark, str(tmp_path), rules).collect()) == kept(every)


def test_several_sources(spark, tree, tmp_path):
    root, _ = tree
    single = tmp_path / "notes.log"
    single.write_bytes(b"kept though a log")
    files = scan_sources(spark, [str(root / "d"), str(single)], [Rule("*.log")])
    got = {(r.source_ord, r.direct, r.path) for r in files.collect()}
    assert got == {(0, False, "e/f.txt"), (0, False, "bin.dat"), (1, True, "notes.log")}
    packed = pack(files, [Rule("*.log")])
    assert [(r.file_count, r.binary_skipped) for r in packed.bundles.collect()] == [(2, 1)]


def test_tree_packs_like_its_table(spark, tree):
    root, _ = tree
    short, whole = pack_tree(spark, str(root)), pack(scan_tree(spark, str(root)))
    assert sorted(short.paragraphs.collect(), key=str) == sorted(whole.paragraphs.collect(), key=str)
    assert [(r.file_count, r.binary_skipped) for r in short.bundles.collect()] == [(5, 1)]
    assert [(r.file_count, r.binary_skipped) for r in whole.bundles.collect()] == [(5, 1)]


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        scan_sources(spark, [])
    with pytest.raises(ValueError):
        union_sources([])
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError):
        pack_sources([])
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, str(tmp_path / "file"))


def test_a_file_that_is_gone_counts_as_binary(spark, tmp_path):
    files = scan_sources(spark, [str(tmp_path / "never.txt")])
    assert [(r.file_count, r.binary_skipped) for r in pack(files).bundles.collect()] == [(0, 1)]


def test_stream_equals_batch(spark, tree):
    root, _ = tree
    table = shared_dir(spark, "files")
    scan_tree(spark, str(root)).repartition(4).write.parquet(table)
    files = read_files(spark, table)
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(table)
    got = drain(spark, pack_arrivals(arriving), "out").collect()
    want = pack(files).paragraphs.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_guard_stream_keeps_one_of_each(spark, tree):
    table = shared_dir(spark, "arrivals")
    rows = [("b", "x", 1), ("b", "x", 2), ("b", "y", 3), ("c", "x", 4)]
    df = spark.createDataFrame(rows, "bundle_id string, path string, t int")
    df.withColumn("at", F.timestamp_seconds("t")).repartition(2).write.parquet(table)
    arriving = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    got = drain(spark, guard_duplicates(arriving, "at", "1 hour"), "guard").collect()
    assert sorted((r.bundle_id, r.path) for r in got) == [("b", "x"), ("b", "y"), ("c", "x")]


def test_progress_counts(spark, tree):
    root, _ = tree
    seen, sniffed = Observation("seen"), Observation("sniffed")
    run = observe_pack(scan_tree(spark, str(root)), default_rules(), [], seen, sniffed)
    run.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 8, "excluded": 2}
    assert (sniffed.get["kept"], sniffed.get["skipped"], sniffed.get["kept_bytes"]) == (5, 1, 10)


def test_progress_of_a_stream(spark, tree):
    root, _ = tree
    table = shared_dir(spark, "files")
    scan_tree(spark, str(root)).write.parquet(table)
    arriving = spark.readStream.schema(read_files(spark, table).schema).parquet(table)
    run = observe_pack(arriving, default_rules(), [], "seen", "sniffed")
    query = start_append(run, shared_dir(spark, "out"), shared_dir(spark, "state"))
    query.awaitTermination()
    metrics = [p["observedMetrics"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(m["seen"]["total"] for m in metrics) == 8
    assert sum(m["sniffed"]["kept"] for m in metrics) == 5


def test_a_large_bundle_is_spread_over_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("bundle_id"),
        F.lit(0).alias("source_ord"),
        F.concat(F.lit("f"), "id").alias("path"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        write_bundle(rows, str(tmp_path / "table"))
    finally:
        spark.conf.unset(key)
    table = read_bundle(spark, str(tmp_path / "table"))
    assert table.count() == 8000
    files = table.filter("bundle_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 3
