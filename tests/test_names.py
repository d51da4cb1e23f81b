"""Duplicate paths, parents and names."""

from pyspark.sql import functions as F

from sheaf.operators.duplicates import duplicate_paths, first_duplicate, reject_duplicates
from sheaf.operators.names import (
    allocate_names,
    common_parent,
    default_unpack_name,
    output_names,
    resolve_output_names,
)


def names(spark, items):
    return spark.createDataFrame([(n,) for n in items], "name string")


def allocate(spark, wanted, used, **kw):
    df = spark.createDataFrame(list(enumerate(wanted)), "request_id int, name string")
    got = {r.request_id: (r.allocated, r.error) for r in allocate_names(df, names(spark, used), **kw).collect()}
    return [got[i] for i in range(len(wanted))]


def test_next_free_name(spark):
    assert allocate(spark, ["p.docx"], []) == [("p.docx", None)]
    assert allocate(spark, ["p.docx"], ["p.docx"]) == [("p_1.docx", None)]
    assert allocate(spark, ["p.docx"], ["p.docx", "p_1.docx", "p_3.docx"]) == [("p_2.docx", None)]
    assert allocate(spark, ["p.docx"], ["p_1.docx"]) == [("p.docx", None)]
    assert allocate(spark, ["d/p.tar.gz", "d/.rc"], ["d/p.tar.gz", "d/.rc"]) == [("d/p.tar_1.gz", None), ("d/.rc_1", None)]
    assert allocate(spark, ["a.b"], ["a.b", "a.b_1"], whole=True) == [("a.b_2", None)]
    assert allocate(spark, ["a.b"], ["a.b", "a.b_1"]) == [("a_1.b", None)]


def test_many_requests_for_one_name(spark):
    got = allocate(spark, ["p.x"] * 4 + ["p_2.x"], ["p.x", "p_1.x"])
    assert [g[0] for g in got] == ["p_3.x", "p_4.x", "p_5.x", "p_6.x", "p_2.x"]
    assert len({g[0] for g in got}) == 5


def test_names_go_on_after_the_last_number(spark):
    got = allocate(spark, ["p"] * 10_010, ["p_7"])
    assert [g[0] for g in got[:9]] == ["p", "p_1", "p_2", "p_3", "p_4", "p_5", "p_6", "p_8", "p_9"]
    assert got[9998] == ("p_9999", None)
    assert len({g[0] for g in got}) == 10_010 and all(g[0].startswith("p_more_") for g in got[9999:])
    assert all(g[1] is None for g in got)


def test_duplicates(spark):
    rows = [("b", "x", 0), ("b", "x", 2), ("b", "y", 1), ("b", "a", 5), ("b", "a", 7), ("b", "x", 9), ("c", "x", 0)]
    df = spark.createDataFrame(rows, "bundle_id string, path string, source_ord int")
    got = {(r.path, r.copies, r.repeat_ord) for r in duplicate_paths(df).collect()}
    assert got == {("x", 3, 2), ("a", 2, 7)}
    assert [tuple(r) for r in first_duplicate(df).collect()] == [("b", "x", 2)]
    assert [r.bundle_id for r in reject_duplicates(df).collect()] == ["c"]
    # Ranks are cut before the shuffle, so endless copies of a path stay on their side.
    assert "WindowGroupLimit" in duplicate_paths(df)._jdf.queryExecution().executedPlan().toString()


def sources(spark, rows):
    return spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, is_dir boolean, explicit string")


def test_common_parent(spark):
    cases = {
        "deep": (["/a/b/x", "/a/b/c/y"], "/a/b"), "root": (["/a", "/b"], None), "apart": (["a/x", "b/y"], None),
        "one": (["a/b/x"], "a/b"), "bare": (["x", "a/y"], None), "near": (["ab/x", "a/y"], None),
        "rootless": (["/x"], None), "same": (["a/x", "a/y", "a/z"], "a"),
    }
    rows = [(k, i, p, False, None) for k, (ps, _) in cases.items() for i, p in enumerate(ps)]
    got = {r.bundle_id: r.common_parent for r in common_parent(sources(spark, rows)).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_output_names(spark):
    rows = [
        ("file", 0, "d/report.final.md", False, None), ("dir", 0, "/data/proj", True, "output.docx"),
        ("given", 0, "x", False, "mine.docx"), ("many", 0, "a/b/x", False, None), ("many", 1, "a/b/y", True, None),
        ("apart", 0, "p/x", False, None), ("apart", 1, "q/y", False, None),
    ]
    df = sources(spark, rows)
    want = {"file": "d/report.final.docx", "dir": "/data/proj.docx", "given": "mine.docx", "many": "a/b/b.docx", "apart": "p/output.docx"}
    assert {r.bundle_id: r.output_name for r in output_names(df).collect()} == want
    renamed = resolve_output_names(df, names(spark, ["a/b/b.docx", "mine.docx"]))
    got = {r.bundle_id: r.output_name for r in renamed.collect()}
    assert got == want | {"many": "a/b/b_1.docx"}
    unpack = names(spark, ["document.docx", "a/b.tar.gz", "/c"]).select(default_unpack_name(F.col("name")).alias("n"))
    assert [r.n for r in unpack.collect()] == ["document_unpacked", "a/b.tar_unpacked", "/c_unpacked"]
