import random
import zlib

import numpy as np
import pyarrow as pa

from sheaf.llm import toxicity
from sheaf.llm.arrays import slices

BAD = ["numbskull", "lowlife", "grotmon"]


def made(seed=1, n=1200):
    r = random.Random(seed)
    say = lambda k: [r.choice(["the", "Haus", "mér", "you", "of", "and"]) + str(r.randrange(60)) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        w = say(r.choice([5, 30, 120]))
        toxic = r.random() < 0.3
        for _ in range(r.randrange(1, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice([*BAD, "schrumpf" + r.choice(["en", "el", "igkeit", "er"])]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def ranked_well(pairs):
    """Share of pairs of a toxic and a clean text in right order."""
    bad, fine = ([s for y, s in pairs if y == v] for v in (1, 0))
    return np.mean([(b > f) + 0.5 * (b == f) for b in bad for f in fine])


def test_held_out_rows(spark):
    docs, labels = made()
    extra = [(5000, None), (5001, ""), (None, "numbskull " * 3), docs[3], docs[3], (5002, "word " * 200_000)]
    rows = toxicity.toxicity_report(*frames(spark, docs + extra, labels + [labels[0], (1, 1, None), (9999, 1, 1)])).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {d: y for d, _, y in labels}
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert ranked_well([h[:2] for h in held]) > 0.97
    assert np.mean([y == p for y, _, p in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels = made(2, 500)
    turned = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, q, y in labels]
    first, second = (sorted(map(tuple, toxicity.toxicity_report(*frames(spark, docs, x)).collect())) for x in (labels, turned))
    assert first == second


def test_copied_toxic_text_is_no_lexicon(spark):
    text = " ".join(f"rare{i}" for i in range(30))
    rows = [(text, 1)] * 60 + [(f"x{i} numbskull y{i}", 1) for i in range(30)] + [(f"x{i} fine y{i}", 0) for i in range(200)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(2))
    assert lexicon.words.tolist() == toxicity._word_list(["numbskull"]).tolist()


def test_few_labels_and_empty_tables(spark):
    docs, labels = made(3, 20)
    assert {r.score for r in toxicity.toxicity_report(*frames(spark, docs, [])).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity_report(*frames(spark, docs, [(d, q, 1) for d, q, _ in labels])).collect()} == {1.0}
    assert toxicity.toxicity_report(*frames(spark, [], [])).count() == 0


def test_dropped_rows_keep_columns(spark):
    docs, labels = made(4, 600)
    d, y = frames(spark, docs, labels)
    d = d.selectExpr("*", "doc_id as score", "'a' as features", "1 as f_words")
    out = toxicity.drop_toxic(d, y)
    assert out.columns == d.columns
    truth = {i: t for i, _, t in labels}
    got = [r.doc_id for r in out.collect()]
    assert np.mean([truth[i] for i in got]) < 0.05 and len(got) > 0.6 * len(docs)


def test_dropped_rows_keep_odd_columns(spark):
    docs, labels = made(4, 300)
    d, y = frames(spark, docs, labels)
    d = d.selectExpr("1 AS `n w`", "doc_id", "named_struct('a b', 2) AS `x ``y`", "text", "3 AS `p.q`", "4 AS own1")
    rows = toxicity.drop_toxic(d, y)
    assert rows.columns == d.columns and 100 < rows.count() < 300
    assert {tuple(r) for r in rows.collect()} <= {tuple(r) for r in d.collect()}
    assert toxicity.drop_toxic(d.limit(0), y).collect() == []


def test_obfuscation_is_undone():
    (s,) = slices(pa.array(["1d10t st.u.p-id looooser a.b 3.5 x", "", "é*é"]))
    clear = toxicity.undone(s.lower())
    text = clear.data.tobytes().decode()
    assert [text[0:0]] and "idiot stupid looser" in text and clear.offsets[-1] == len(clear.data) and clear.rows == 3
