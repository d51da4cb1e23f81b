from collections import Counter

import duckdb
import pytest

from sheaf.llm import rollup
from sheaf.session import shared_dir


def store(spark):
    return rollup.Rollup(spark, shared_dir(spark, "rollup"))


def frame(spark, rows):
    return spark.createDataFrame(rows, rollup.DELTAS)


def plain(*batches):
    docs, tokens = Counter(), Counter()
    for source, lang, tok, kind, new, old in (r for b in batches for r in b):
        k = (source, lang, tok)
        docs[k] += {"insert": 1, "delete": -1, "revise": 0}[kind]
        tokens[k] += {"insert": new or 0, "delete": -(new or 0), "revise": (new or 0) - (old or 0)}[kind]
    return sorted(((*k, docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]), key=repr)


def totals(r):
    return sorted((tuple(x) for x in r.totals().collect()), key=repr)


A = [("s", "en", "v1", "insert", 10, None), ("s", "en", "v1", "insert", 10, None), (None, "de", "v1", "insert", None, None), ("t", None, "v2", "insert", 7, None)]
B = [("s", "en", "v1", "revise", 12, 10), ("s", "en", "v1", "delete", 10, None), ("t", None, "v2", "delete", 7, None)]
C = [("s", "en", "v1", "delete", 12, None), ("u", "en", "v1", "insert", 5, None)]


def test_batches_add_up_and_commits_repeat(spark):
    r = store(spark)
    assert totals(r) == []
    r.commit("a", frame(spark, A))
    r.commit("b", frame(spark, B))
    r.commit("b", frame(spark, B))
    assert totals(r) == plain(A, B)
    r.commit("b", frame(spark, C))  # a batch id is one batch
    assert totals(r) == plain(A, C)
    r.commit("empty", frame(spark, []))
    assert totals(r) == plain(A, C)


def test_compaction_changes_nothing(spark):
    r = store(spark)
    r.commit("a", frame(spark, A))
    r.compact()
    r.commit("a", frame(spark, A))  # again after it is compacted
    r.commit("b", frame(spark, B))
    assert totals(r) == plain(A, B)
    r.compact()
    r.commit("c", frame(spark, C))
    assert totals(r) == plain(A, B, C)


def test_half_written_batch_does_not_count(spark):
    r = store(spark)
    r.commit("a", frame(spark, A))
    rollup._sums(rollup.signed(frame(spark, B))).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{r.store}/batch=half")
    assert totals(r) == plain(A)


def test_wrong_input(spark):
    r = store(spark)
    with pytest.raises(ValueError):
        r.commit("a/../b", frame(spark, A))
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("x", frame(spark, [("s", "en", "v1", "moved", 1, None)]))
    assert totals(r) == []


def test_other_columns_and_document_log(spark, sf_dir):
    df = spark.createDataFrame([("s", "en", "v1", "insert", 3, None, 1, 2)], rollup.DELTAS + ", n_docs int, text int")
    r = store(spark)
    r.commit("a", df)
    assert totals(r) == [("s", "en", "v1", 1, 3)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = store(spark)
    for name, deltas in rollup.document_log(docs):
        r.commit(name, deltas)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert totals(r) == sorted(con.execute(rollup.SQL).fetchall(), key=repr)
