"""A watched tree against its files, with stops at every step, and tables in which bundles are replaced."""

import os

from pyspark.sql import functions as F

from sheaf.functions.globs import parse_rules
from sheaf.plans.pack import pack, pack_once, pack_sources
from sheaf.schemas import FILES
from sheaf.sources.slots import read_slots, replace_bundles, write_slots
from sheaf.streaming.arrivals import WatchedTree


def put(root, **files):
    for name, body in files.items():
        name = name.replace("__", "/").replace("DOT", ".")
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)


def taken(tree):
    return sorted((r.path, r.line_no, r.text) for r in tree.paragraphs().collect())


def plain(files):
    return sorted(row for p, t in files.items() for row in [(p, 0, p), *((p, i + 1, x) for i, x in enumerate(t.split("\n")) if t)])


def test_every_file_once_dot_names_and_empty_files_too(spark, tmp_path):
    root = str(tmp_path / "in")
    os.makedirs(root)
    tree = WatchedTree(spark, root, str(tmp_path / "store"), parse_rules("*.log"))
    assert tree.take() is None and taken(tree) == []
    put(root, a=b"one\ntwo", DOThidden=b"h", _under=b"u", sub__empty=b"", sub__binary=b"\0\1\2\0", skipDOTlog=b"x")
    assert tree.take() == 1
    want = {"a": "one\ntwo", ".hidden": "h", "_under": "u", "sub/empty": ""}
    assert taken(tree) == plain(want)
    put(root, a=b"changed", sub__late=b"l")
    assert tree.take() == 2
    want["sub/late"] = "l"
    assert taken(tree) == plain(want)
    assert tree.take() is None and taken(tree) == plain(want)


def test_a_stop_after_any_step_adds_nothing_twice(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    put(root, a=b"1", b=b"2")
    tree = WatchedTree(spark, root, str(tmp_path / "store"), [])
    finish = WatchedTree._finish
    monkeypatch.setattr(WatchedTree, "_finish", lambda self, n: (_ for _ in ()).throw(RuntimeError("stop")))
    try:
        tree.take()
    except RuntimeError:
        pass
    monkeypatch.setattr(WatchedTree, "_finish", finish)
    put(root, c=b"3")  # came after the ledger was written, so it is not of that batch
    assert taken(tree) == []
    assert tree.take() == 1 and taken(tree) == plain({"a": "1", "b": "2"})
    os.remove(tmp_path / "store/rows/batch=000000001/_SUCCESS")  # as if stopped while rows were written
    assert taken(tree) == []
    again = WatchedTree(spark, root, str(tmp_path / "store"), [])
    assert again.take() == 1 and again.take() == 2 and again.take() is None
    assert taken(again) == plain({"a": "1", "b": "2", "c": "3"})


def texts(spark, bundles):
    rows = [(b, 0, p, t) for b, files in bundles.items() for p, t in files.items()]
    return spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, text string")


def shown(df):
    return sorted(((r.bundle_id or "", r.path, r.line_no, r.text) for r in df.collect()))


def want(bundles):
    return sorted((b or "", *row) for b, files in bundles.items() for row in plain(files))


def parts(path):
    return {
        os.path.relpath(os.path.join(folder, f), path)
        for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_replacing_rewrites_the_slots_of_the_bundles_only(spark, tmp_path):
    table = str(tmp_path / "t")
    held = {f"b{i}": {"x": f"{i}\nline", "y/z": ""} for i in range(30)} | {None: {"n": "null bundle"}}
    write_slots(texts(spark, held), table, slots=8)
    before = parts(table)
    assert shown(read_slots(spark, table)) == want(held)
    fresh = {"b3": {"x": "new"}, "added": {"q": "1"}, None: {"m": "other"}}
    replace_bundles(texts(spark, fresh), table)
    held |= fresh
    assert shown(read_slots(spark, table)) == want(held)
    lies = {r.s for r in texts(spark, fresh).select(F.expr("pmod(xxhash64(bundle_id), 8)").alias("s")).collect()}
    moved = {p.split("/")[1] for p in before ^ parts(table)}
    assert moved == {f"slot={s}" for s in lies} and len(lies) < 8
    replace_bundles(texts(spark, fresh), table)
    assert shown(read_slots(spark, table)) == want(held)
    replace_bundles(texts(spark, held).limit(0), table)
    assert shown(read_slots(spark, table)) == want(held)


def test_a_reader_of_one_bundle_opens_its_slot_only(spark, tmp_path):
    table = str(tmp_path / "t")
    held = {f"b{i}": {"x": str(i)} for i in range(30)}
    write_slots(texts(spark, held), table, slots=8)
    one = read_slots(spark, table, ["b7"])
    assert shown(one) == want({"b7": held["b7"]})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read_slots(spark, table, []).isEmpty()


def test_a_single_table_gives_the_results_of_packing_twice(spark):
    body = {"a": b"one\ntwo", "b": b"\0\1\2\0", "c": "é".encode("latin-1") * 3, "d": b"", "x.log": b"l"}
    rows = [(b, i, False, p, len(t), t) for b in "pq" for i, (p, t) in enumerate(body.items())]
    rows += [("q", 9, False, "a", 5, b"again"), ("q", 9, False, "b", 4, b"\0\1\2\0"), ("r", 1, False, "u", None, None)]
    files = spark.createDataFrame([(b, i, d, p, n, t and bytearray(t)) if t != b"" else (b, i, d, p, n, bytearray()) for b, i, d, p, n, t in rows], FILES)
    rules = parse_rules("*.log")
    got, two = pack_once(files, rules), pack_sources([files], rules)
    for name in ("paragraphs", "bundles"):
        assert sorted(map(repr, getattr(got, name).collect())) == sorted(map(repr, getattr(two, name).collect()))
    one = files.filter("bundle_id = 'p'")
    assert sorted(map(repr, pack_once(one, rules).paragraphs.collect())) == sorted(map(repr, pack(one, rules).paragraphs.collect()))
    for df in got:
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()  # nothing is sniffed again
