import hashlib
import random
import re

import pytest

from sheaf.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, window=13):
    words = lambda t: WORD.findall((t or "").translate(LOW))
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[k]
        ids = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in decontaminate.contamination_report(d, b, **options).collect()), key=repr)


def made(seed, vocabulary=6, n=60):
    r = random.Random(seed)
    say = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(["Ab", "c", "Dé", "e1", "f", "GG", "日本", "h"][:vocabulary]) for _ in range(k))
    items = [(i, say(r.choice([0, 1, 2, 5, 12, 13, 14, 20, 40]))) for i in range(12)] + [(3, say(15)), (20, None), (None, say(20))]
    docs = [(i, say(r.choice([0, 1, 3, 12, 13, 30, 200]))) for i in range(n)]
    docs += [(100 + i, say(r.randrange(30)) + " " + (r.choice(items)[1] or "") + " " + say(r.randrange(30))) for i in range(n)]
    return docs + [(500, None), (501, ""), (None, docs[70][1]), docs[75], docs[75]], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_plain_search(spark, seed):
    docs, items = made(seed, 6 if seed < 3 else 8)
    assert ours(spark, docs, items) == plain(docs, items)


def test_blocks_change_nothing(spark):
    docs, items = made(4, 8)
    assert ours(spark, docs, items, block_words=30) == plain(docs, items)


def test_long_text_and_only_long_items(spark):
    r = random.Random(5)
    say = lambda k: " ".join(f"w{r.randrange(3000)}" for _ in range(k))
    items = [(i, say(60)) for i in range(40)]
    docs = [(1, say(150_000) + " " + items[3][1] + " " + say(150_000)), (2, items[5][1][:90]), (3, "x " * 400_000)]
    assert ours(spark, docs, items) == plain(docs, items)


def test_empty_tables_and_other_columns(spark):
    assert [r[1:4] for r in ours(spark, [(1, "a b c")], [])] == [(3, 0, 0)]
    assert ours(spark, [], [(1, "a b c")]) == []
    d = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id bigint, text string, item_id int, `n w` string")
    b = spark.createDataFrame([(1, "B C", 2)], "item_id bigint, text string, doc_id int")
    assert decontaminate.drop_contaminated(d, b).collect() == []
    assert [tuple(r) for r in decontaminate.drop_contaminated(d, b.filter("false")).collect()] == [(1, "a b c", 5, "x")]


def test_smallest_tables(spark, sf_dir):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
        for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    got = ours(spark, docs, items)
    assert got == plain(docs, items)
    assert any(r[-1] for r in got)
