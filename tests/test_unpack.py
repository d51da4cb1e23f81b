"""Segments, folding, path checks and the way from files to rows and back."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import queries
from catalog.oracle import ORACLE
from sheaf.functions.paths import extension, file_identity, parent, stem, validate_heading
from sheaf.functions.globs import Rule
from sheaf.operators.segment import (
    fold_content,
    fold_files,
    heading_files,
    last_write_wins,
    segment_by_heading,
    stop_at_first_bad_bundle,
    unpack_summary,
)
from sheaf.operators.paragraphs import build_paragraphs
from sheaf.operators.ranks import rank_rows
from sheaf.operators.summary import roundtrip_diff
from sheaf.plans.pack import pack, pack_sources
from sheaf.plans.unpack import unpack, unpack_report, unpack_stream
from sheaf.schemas import FILES
from sheaf.sources.bundles import read_bundle, write_bundle, write_unpacked
from tests.compare import mismatch

H = "Heading1"
STREAM = "bundle_id string, seq bigint, style string, text string"


def stream(spark, rows, bundle="b"):
    data = [(bundle, i, H if head else None, text) for i, (head, text) in enumerate(rows)]
    return spark.createDataFrame(data, STREAM)


def files_of(df):
    return {r.path: r.content for r in df.collect()}


CASES = [
    ([(1, "f1"), (0, "c1"), (1, "f2"), (1, "f3"), (0, "c3")], {"f1": "c1", "f2": "", "f3": "c3"}),
    ([(1, "f1"), (0, "c1"), (1, "f2")], {"f1": "c1", "f2": ""}),
    ([(1, "f1"), (0, "1"), (0, "2"), (0, "3"), (1, "f2"), (0, "c")], {"f1": "1\n2\n3", "f2": "c"}),
    ([(1, "f"), (0, "1\n2\n3")], {"f": "1\n2\n3"}),
    ([(0, "x"), (1, "a"), (0, "y")], {"a": "y"}),
    ([(1, ""), (0, "x"), (1, "a"), (0, "y")], {"a": "y"}),
    ([(1, "a"), (0, "1"), (1, "a"), (0, "2")], {"a": "2"}),
    ([(1, "a"), (0, "1"), (1, "../b"), (0, "2"), (1, "c"), (0, "3")], {"a": "1"}),
    ([(1, "a"), (0, ""), (0, " 1"), (0, ""), (0, "\n\n"), (0, "")], {"a": "\n 1"}),
    ([(1, "a"), (0, None), (0, "1")], {"a": "\n1"}),
    ([(1, "x/./a"), (0, "1"), (1, "x//a"), (0, "2")], {"x//a": "2"}),
    ([(0, "only body")], {}),
]


@pytest.mark.parametrize("rows,want", CASES)
def test_pinned_streams(spark, rows, want):
    assert files_of(unpack_stream(stream(spark, rows))) == want


def test_skip_keeps_the_good_rest(spark):
    df = stream(spark, CASES[7][0])
    assert files_of(unpack_stream(df, on_error="skip")) == {"a": "1", "c": "3"}
    assert [(r.file_count, r.error) for r in unpack_report(df).collect()] == [(1, "traversal")]
    with pytest.raises(ValueError):
        unpack_stream(df, on_error="guess")


def test_compat_trims_every_line(spark):
    df = stream(spark, [(1, " a "), (0, "  x \n\ty"), (0, "  ")])
    assert files_of(unpack_stream(df)) == {"a": "  x \n\ty\n  "}
    assert files_of(unpack_stream(df, compat_trim=True)) == {"a": "x\ny"}


def random_stream(spark, n=400):
    rnd = random.Random(11)
    rows = []
    for bundle, size in (("hot", n), ("a", 20), ("b", 3), ("c", 1)):
        seq = 0
        for _ in range(size):
            seq += rnd.randint(1, 3)
            head = rnd.random() < 0.1
            rows.append((bundle, seq, H if head else None, f"f{rnd.randint(0, 15)}" if head else rnd.choice(["", "x", "\n", " y"])))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, STREAM)


def flags(df):
    heading = F.coalesce(F.col("style") == H, F.lit(False))
    return df.select("bundle_id", "seq", heading.alias("is_heading"), F.coalesce(F.translate("text", "\n", "") != "", F.lit(False)).alias("has_text"))


@pytest.mark.parametrize("span,blocks", [(1, 1000), (2, 7), (3, 1), (7, 50), (1 << 17, 10_000)])
def test_blocks_give_what_one_window_gives(spark, span, blocks):
    df = random_stream(spark)
    whole = Window.partitionBy("bundle_id").orderBy("seq")
    want = df.withColumn("n", F.count(F.when(F.col("style") == H, 1)).over(whole)).withColumn(
        "h", F.last(F.when(F.col("style") == H, F.col("seq")), ignorenulls=True).over(whole)
    )
    ranked = rank_rows(flags(df), span, blocks)
    assert blocks == 1 or span > 400 or len(ranked.bounds) > 3
    got = segment_by_heading(df, ranked)
    pairs = want.join(got, ["bundle_id", "seq"]).select("n", "seg_no", "h", "seg_seq").collect()
    assert len(pairs) == df.count() and all((r.n, r.h) == (r.seg_no, r.seg_seq) for r in pairs)


def test_ranks_are_dense(spark):
    df = random_stream(spark).unionByName(random_stream(spark).withColumn("bundle_id", F.lit(None).cast("string"))).repartition(7)
    ranked = rank_rows(flags(df), 5, 20)
    rows = ranked.rows.withColumn("block", ranked.block(F.col("bundle_id"), F.col("seq"))).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(df.count()))
    assert [(r.bundle_id or "", r.seq) for r in rows] == sorted((r.bundle_id or "", r.seq) for r in rows)
    blocks = [r.block for r in rows]
    assert blocks == sorted(blocks) and set(blocks) == set(range(len(ranked.bounds) + 1)) and len(ranked.bounds) > 5
    starts = {}
    for r in rows:
        if r["at"] == 0 and (r.is_heading or r.seg_no == 0):
            starts[r.bundle_id, r.seg_no] = r["rank"]
        assert r["at"] == r["rank"] - starts[r.bundle_id, r.seg_no] and r["first"] == (r["at"] % 5 == 0)
    for x, y in zip(rows, rows[1:]):
        assert x.block == y.block or y["first"]
    assert max(blocks.count(b) for b in set(blocks)) <= -(-len(rows) // 20) + 5


@pytest.mark.parametrize("span,size", [(1 << 17, 1 << 26), (3, 1 << 26), (4, 3)])
def test_positions_far_apart(spark, span, size):
    """Gaps of any width give the files that neighbouring positions give."""
    df = random_stream(spark)
    order = Window.partitionBy("bundle_id").orderBy("seq")
    near = df.withColumn("seq", F.row_number().over(order).cast("bigint"))
    # first neighbours, then gaps of 10^15 and more, up to both ends of a long
    far = near.withColumn("seq", F.when(F.col("seq") < 50, F.col("seq") - F.lit(1 << 62)).otherwise(F.col("seq") * 10**15 + F.col("seq") % 7))

    def files(rows):
        out = {}
        for r in unpack_stream(rows, on_error="skip", span=span, part_bytes=size).orderBy("part_no").collect():
            out.setdefault((r.bundle_id, r.seg_no, r.path), []).append((r.part_no, r.content))
        return out

    got = files(far)
    assert got == files(near) and len(got) > 10
    assert span < 10 or all(len(parts) == 1 for parts in got.values())
    cut = segment_by_heading(far)
    assert cut.count() == df.count()
    wide = fold_content(cut, span=span, part_bytes=size).filter("heading <> ''").groupBy("bundle_id", "seg_no").count()
    assert wide.filter("count > 1").isEmpty() == (span > 10)


@pytest.mark.parametrize("span,size", [(1 << 17, 1 << 26), (3, 1 << 26)])
def test_positions_beyond_a_long(spark, span, size):
    """Positions may be decimals, also where blocks are cut."""
    df = random_stream(spark)
    beyond = df.withColumn("seq", F.expr("CAST(seq AS DECIMAL(19, 0)) * 10000000000000000000BD - 5").cast("decimal(38, 0)"))
    files = lambda rows: sorted(tuple(r) for r in unpack_stream(rows, on_error="skip", span=span, part_bytes=size).drop("heading").collect())
    assert files(beyond) == files(df) and len(files(df)) > 10


def test_sparse_positions_of_large_numbers(spark, tmp_path):
    """Numbers of documents whose sparse positions are no longs, and a file of more than 10,000 lines."""
    long = "\n".join(f"line {i}" for i in range(10_020))
    rows = [(n, "src1", "en", text) for n, text in ((6, long), (7, "x"), (11, "a\nb"), (100_001, "c"), (2**62 + 1, "d"), (-100_003, "e"))]
    pq.write_table(pa.table(dict(zip(("doc_id", "source", "lang", "text"), map(list, zip(*rows))))), tmp_path / "documents.parquet")
    assert mismatch(queries.unpack_sparse(spark, str(tmp_path)), str(tmp_path), ORACLE["unpack_sparse"]) is None


@pytest.mark.parametrize("part,size", [(1, 1 << 26), (2, 1 << 26), (5, 1 << 26), (1 << 17, 1), (4, 3), (1 << 17, 1 << 26)])
def test_parts_join_to_the_whole(spark, part, size):
    df = segment_by_heading(random_stream(spark))
    whole = {(r.bundle_id, r.seg_no): (r.heading, r.content) for r in fold_content(df).collect()}
    got = {}
    for r in fold_content(df, span=part, part_bytes=size).orderBy("part_no").collect():
        got.setdefault((r.bundle_id, r.seg_no), []).append((r.heading, r.content, r.part_no))
    assert got.keys() == whole.keys()
    assert part > 5 < size or any(len(v) > 1 for v in got.values())
    for key, parts in got.items():
        assert {p[0] for p in parts} == {whole[key][0]}
        assert "\n".join(p[1] for p in parts) == whole[key][1], key


def test_content_is_never_windowed_by_bundle(spark):
    plan = unpack_stream(random_stream(spark))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "text" in line.split("]")[0]:
            raise AssertionError(line)


def exchanges_of(df, column):
    """How many shuffles of a plan carry a column."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = plan.split("\n\n")
    return sum(1 for p in parts if re.match(r"\(\d+\) Exchange", p.strip()) and re.search(rf"Input \[\d+\]: \[.*\b{column}#", p))


def test_text_moves_once_without_broadcasts(spark, tmp_path):
    paragraphs = build_paragraphs(spark.createDataFrame([("b", 0, "a", "1\n2")], "bundle_id string, source_ord int, path string, text string"))
    paragraphs.write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Headings are few rows of the same column: their shuffles hold line 0 only.
        plan = unpack(read_bundle(spark, str(tmp_path / "p")))
        assert exchanges_of(plan, "text") == 1
        assert exchanges_of(plan, "content") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("span", [1 << 17, 5])
def test_text_of_a_stream_moves_once(spark, span):
    df = random_stream(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = unpack_stream(df, span=span)
        # The other shuffle of the column is that of headings, whose text is a path.
        assert exchanges_of(plan, "text") == 1 and exchanges_of(plan, "content") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("size", [1, 4, 1 << 26])
def test_files_in_parts_compare_as_one(spark, size):
    rows = [("b", 0, "a", "\n".join(f"line {i % 7}" for i in range(500)) + "\n\n"), ("b", 1, "c", "\n\nx\n\ny"), ("b", 2, "e", "")]
    texts = spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, text string")
    after = unpack(build_paragraphs(texts), span=64, part_bytes=size)
    got = {r.path: (r.status, r.lines_before, r.lines_after) for r in roundtrip_diff(texts, after).collect()}
    assert got == {"a": ("same", 500, 500), "c": ("same", 5, 5), "e": ("same", 0, 0)}
    moved = after.withColumn("content", F.when(F.col("path") == "c", F.replace("content", F.lit("x"), F.lit("z"))).otherwise(F.col("content")))
    got = {r.path: r.status for r in roundtrip_diff(texts, moved).collect()}
    assert got == {"a": "same", "c": "changed", "e": "same"}


def test_summary_and_batches(spark):
    rows = [("x", 0, H, "a", 0), ("x", 1, H, "b", 0), ("y", 0, H, "c", 1), ("y", 1, H, "../d", 1), ("y", 2, H, "e", 1), ("z", 0, H, "f", 2)]
    df = spark.createDataFrame(rows, STREAM + ", bundle_ord int")
    order = df.select("bundle_id", "bundle_ord").distinct()
    heads = heading_files(df).join(order, "bundle_id")
    assert sorted(r.path for r in stop_at_first_bad_bundle(heads).collect()) == ["a", "b", "c"]
    good = heads.filter("error IS NULL")
    assert sorted(r.path for r in stop_at_first_bad_bundle(good.filter("bundle_id <> 'y'")).collect()) == ["a", "b", "f"]
    counts = {r.bundle_id: r.file_count for r in unpack_summary(good).collect()}
    assert counts == {"x": 2, "y": 2, "z": 1, None: 5}


PATHS = [
    ("src/main.rs", "src/main.rs", None), ("src\\main.rs", "src/main.rs", None), ("  a.txt ", "a.txt", None),
    (" \t ", None, "empty"), ("/etc/x", None, "absolute"), ("//srv/x", None, "absolute"), ("C:", None, "absolute"),
    ("C:\\x", None, "absolute"), ("C:/x", None, "absolute"), ("C:foo", "C_foo", None), ("a/../b", None, "traversal"),
    ("a/CON", None, "reserved"), ("con.txt", None, "reserved"), ("x/lpt1.log", None, "reserved"),
    ("con.tar.gz", "con.tar.gz", None), ("con/../x", None, "reserved"), ("../con", None, "traversal"),
    ('a<b>:c"d|e?f*g', "a_b__c_d_e_f_g", None), ("./a//b", "./a//b", None), ("a\0b", "a_b", None),
    ("..a/b..", "..a/b..", None), ("com0", "com0", None), ("COM9.x/y", None, "reserved"), ("\u3000a\u00a0", "a", None),
    ("xcon", "xcon", None), ("con.", None, "reserved"), (".con", ".con", None), ("1:/x", "1_/x", None),
]


def test_headings_become_paths(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PATHS)], "i int, h string")
    got = {r.i: (r.c.path, r.c.error) for r in df.select("i", validate_heading(F.col("h")).alias("c")).collect()}
    assert got == {i: (p[1], p[2]) for i, p in enumerate(PATHS)}


def test_path_parts(spark):
    cases = {
        "a/b.txt": ("a", "b", "txt"), "b": ("", "b", None), "/b.x.y": ("/", "b.x", "y"), "a/.hid": ("a", ".hid", None),
        "a/b.": ("a", "b", ""), "a/b/": ("a", "b", None), "/": ("/", "", None),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    got = {r.p: (r.a, r.s, r.e) for r in df.select("p", parent(p).alias("a"), stem(p).alias("s"), extension(p).alias("e")).collect()}
    assert got == cases
    same = spark.createDataFrame([("./a//b/",), ("a/b",), ("a/./b",)], "p string")
    assert {r.i for r in same.select(file_identity(p).alias("i")).collect()} == {"a/b"}


def files_table(spark, rows):
    data = [(b, o, d, p, len(c), bytearray(c)) for b, o, d, p, c in rows]
    return spark.createDataFrame(data, FILES)


TREE = [
    ("p", 0, False, "src/main.rs", b"fn main() {\n    body\n}\n"),
    ("p", 0, False, "readme.md", b"# Title\r\n\r\ntext"),
    ("p", 0, False, "empty.txt", b""),
    ("p", 0, False, "logo.dat", b"\x00\x01\x02"),
    ("p", 0, False, ".git/config", b"x"),
    ("q", 0, False, "readme.md", "\u4f60\u597d".encode("gbk")),
]


def test_pack_and_unpack(spark, tmp_path):
    packed = pack(files_table(spark, TREE))
    counts = {r.bundle_id: (r.file_count, r.binary_skipped) for r in packed.bundles.collect()}
    assert counts == {"p": (3, 1), "q": (1, 0)}
    table, out = str(tmp_path / "bundles"), str(tmp_path / "out")
    write_bundle(packed.texts, table)
    assert read_bundle(spark, table, ["q"]).count() == 2
    write_unpacked(unpack(read_bundle(spark, table)), out)
    got = {(r.bundle_id, r.path): r.content for r in spark.read.parquet(out).collect()}
    assert got == {
        ("p", "src/main.rs"): "fn main() {\n    body\n}", ("p", "readme.md"): "# Title\n\ntext",
        ("p", "empty.txt"): "", ("q", "readme.md"): "\u4f60\u597d",
    }
    diff = roundtrip_diff(packed.texts, spark.read.parquet(out)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in diff} == {"same": 4}


@pytest.mark.parametrize("span", [1, 3, 1 << 17])
def test_long_files_of_a_table_come_in_parts(spark, span):
    rows = [("b", 0, "a", "1\n\n2\n3\n\n\n\n\n"), ("b", 1, "e", ""), ("b", 2, "n", "\n\n\n\n"), ("b", 3, "s", "x")]
    texts = spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, text string")
    got = {}
    for r in fold_files(build_paragraphs(texts), span, part_bytes=1 << 20).orderBy("part_no").collect():
        assert r.heading == r.path
        got.setdefault(r.path, []).append(r.content)
    assert {k: "\n".join(v) for k, v in got.items()} == {"a": "1\n\n2\n3", "e": "", "n": "", "s": "x"}
    assert span > 3 or len(got["a"]) > 1


def test_keyed_unpack_checks_and_dedups(spark):
    rows = [("b", 0, "a", "1"), ("b", 1, "a", "2"), ("b", 2, "../x", "3"), ("b", 3, "c", "4"), ("d", 0, "e", "")]
    paragraphs = build_paragraphs(spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, text string"))
    assert {(r.bundle_id, r.path, r.content) for r in unpack(paragraphs).collect()} == {("b", "a", "2"), ("d", "e", "")}
    assert {r.path for r in unpack(paragraphs, on_error="skip").collect()} == {"a", "c", "e"}


def test_sources_with_one_path_fail_their_bundle(spark):
    one = files_table(spark, [("b", 0, False, "x.txt", b"one"), ("c", 0, False, "y.bin", b"\0"), ("c", 0, False, "z", b"")])
    two = files_table(spark, [("b", 1, False, "x.txt", b"two"), ("c", 1, False, "y.bin", b"text"), ("c", 1, True, "k.log", b"l")])
    packed = pack_sources([one, two], [Rule("*.log")])
    got = {r.bundle_id: (r.file_count, r.binary_skipped, r.error) for r in packed.bundles.collect()}
    # A repeat counts between text files only, and a file named directly is not subject to rules.
    assert got == {"b": (2, 0, "duplicate path: x.txt"), "c": (3, 1, None)}
    assert {r.path for r in packed.texts.collect()} == {"y.bin", "z", "k.log"}
    with pytest.raises(ValueError):
        pack_sources([])


def test_a_path_repeated_by_most_rows(spark):
    rows = [("b", i, "same" if i % 3 else f"f{i}", None) for i in range(300)]
    df = spark.createDataFrame(rows, "bundle_id string, seg_seq int, path string, error string")
    kept = {(r.path, r.seg_seq) for r in last_write_wins(df).collect()}
    assert len(kept) == 101 and ("same", 299) in kept
