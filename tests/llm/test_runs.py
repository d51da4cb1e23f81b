import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from sheaf.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, min_length=24, exponent=3):
    """Every maximal stretch per period, longest repeats only of its smallest period."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_length, exponent * q):
                if not any(s <= i and i + length <= s + size and q % p == 0 for s, size, p in out):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_report(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for doc, text in rows:
        w = plain_planted(doc, text)
        found = plain_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc, len(found), *four, sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapsed(w, found)), len(w)))
    return sorted(out, key=repr)


def report(df):
    return sorted((tuple(r) for r in runs.run_report(df).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def noisy(r, vocabulary):
    """Words with repeats inside repeats, broken and whole."""
    say = lambda k: [r.choice(["a", "B", "é", "日本", "x#", "b"]) + str(r.randrange(vocabulary)) for _ in range(k)]
    w = say(r.randrange(30))
    for _ in range(r.randrange(4)):
        part = say(r.randrange(1, 9))
        if r.random() < 0.4:
            part = part * r.randrange(2, 5) + say(1)
        w += part * r.randrange(1, 12) + part[: r.randrange(len(part) + 1)] + say(r.choice([0, 0, 1, 12]))
    return w


@pytest.mark.parametrize("vocabulary", [1, 2, 50])
def test_equal_to_plain_search(spark, vocabulary):
    r = random.Random(vocabulary)
    rows = [(i, r.choice([" ", "\n", " \t "]).join(noisy(r, vocabulary))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, " ".join(["x", "y"] * 20)), rows[7], rows[7]]
    got = report(frame(spark, rows))
    assert got == plain_report(rows)
    assert sum(x[1] for x in got) > 60


def test_words_over_two_letters(spark):
    """Random, Fibonacci and overlap-free words, where stretches repeat at every scale."""
    r = random.Random(3)
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    free = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    texts = [fib[-1], fib[-1] * 2, free, free[:40] * 5, "a" * 90, "ab" * 13 + "a" + "ba" * 13]
    texts += ["".join(r.choice("ab") for _ in range(300)) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert report(frame(spark, rows)) == plain_report(rows)


@pytest.mark.parametrize("min_length, exponent", [(4, 2), (9, 3), (10, 4)])
def test_other_bounds(spark, min_length, exponent):
    r = random.Random(min_length)
    texts = [noisy(r, 2) for _ in range(60)] + [[r.choice("ab") for _ in range(60)] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id int, text string")
    for row in runs.find_runs(df, min_length=min_length, exponent=exponent).collect():
        want = plain_runs(texts[row.doc_id], min_length, exponent)
        assert [tuple(x) for x in row.runs] == want
        assert row.collapsed == collapsed(texts[row.doc_id], want)


def test_long_texts(spark):
    r = random.Random(5)
    part = [f"w{r.randrange(500)}" for _ in range(2_000)]
    texts = [["ha"] * 150_000, part * 20 + ["end"], [f"v{r.randrange(9)}" for _ in range(60_000)]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id int, text string")
    got = {x.doc_id: x for x in runs.find_runs(df).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 150_000, 1)] and got[0].collapsed == "ha"
    assert [tuple(x) for x in got[1].runs] == [(0, 40_000, 2_000)] and got[1].collapsed == " ".join([*part, "end"])
    assert not got[2].runs and got[2].collapsed == " ".join(texts[2])


def test_empty_table_and_names(spark):
    assert report(frame(spark, [])) == []
    df = spark.createDataFrame([(1, "a  b", 7, "n", 3, 4)], "doc_id int, `my text` string, n_words int, `x ``y` string, collapsed int, `p.q` int")
    row = runs.find_runs(df, text_col="my text").first()
    assert row.asDict() == {"doc_id": 1, "my text": "a  b", "x `y": "n", "p.q": 4, "n_words": 2, "runs": [], "collapsed": "a b"}


def test_smallest_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert report(frame(spark, rows)) == plain_report(rows)
