import random
import re
from collections import Counter, defaultdict

from sheaf.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, limit, min_words=10, min_share=0.2):
    lines_of = lambda t: [tuple(WORD.findall(x.translate(LOW))) for x in (t or "").split("\n")]
    held = defaultdict(set)
    for _, host, text in rows:
        for line in lines_of(text):
            if line:
                held[host, line].add(text)
    out = []
    for doc, host, text in rows:
        t = text or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        left = len(w) - sum(len(x) for x in lines_of(text) if x and len(held[host, x]) > limit)
        kept = not failed and left >= min_words and left >= min_share * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), failed, kept))
    return sorted(out, key=repr)


def ours(spark, rows, limit):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    got = quality.quality_report(df, line_limit=limit).drop("lost_words")
    names = ["doc_id", *(quality.BASE), "base_failed", "kept"]
    assert sorted(got.columns) == sorted(names)
    return sorted((tuple(r) for r in got.select(names).collect()), key=repr)


def test_equal_to_plain_count(spark):
    r = random.Random(1)
    say = lambda k, v=40: r.choice([" ", "  ", "\t"]).join(r.choice(["Ab", "é", "c#", "日本", "|", "dd", "E"]) + str(r.randrange(v)) for _ in range(k))
    common = [say(12), say(3), "All rights reserved."]
    rows = []
    for i in range(200):
        parts = [say(r.choice([0, 1, 4, 9, 30]), r.choice([2, 900])) for _ in range(r.randrange(5))]
        parts += [x if r.random() < 0.5 else " " + x.upper().lower() + "\t" for x in common if r.random() < 0.4]
        r.shuffle(parts)
        rows.append((i, r.choice(["a", "a", "b", None]), "\n".join(parts)))
    rows += [(300, "a", None), (301, None, ""), (302, "a", "\n\n \n"), (None, "b", say(20)), rows[5], rows[5]]
    rows += [(400 + i, "c", "the very same text of a page\nthat has many copies and stays as it is whole") for i in range(30)]
    assert ours(spark, rows, 10) == plain(rows, 10)


def test_copies_do_not_make_lines_frequent(spark):
    """Lines of more rows than the limit, some of them of few distinct texts; hosts count by themselves."""
    shared, rows = "a line that several texts of the host hold today", []
    for k in range(4):
        body = "\n".join([f"own line {k} {j} with words of its own here" for j in range(3)] + [shared])
        rows += [(100 * k + i, "a", body) for i in range(8)]
    rows += [(900 + i, None, f"{shared}\nanother line number {i} of the host without a name") for i in range(7)]
    assert ours(spark, rows, 3) == plain(rows, 3)
    assert ours(spark, rows, 4) == plain(rows, 4)
    assert ours(spark, rows, 7) == plain(rows, 7)


def test_long_text(spark):
    text = "\n".join(f"line {i} of the text {i % 5000} and so on" for i in range(30_000))
    rows = [(1, "a", text), (2, "a", "ha " * 200_000)]
    assert ours(spark, rows, 10) == plain(rows, 10)


def test_empty_and_other_columns(spark):
    assert ours(spark, [], 10) == []
    df = spark.createDataFrame([(1, "s", "a b", 3, 4)], "doc_id bigint, source string, text string, n_words int, host int")
    assert quality.quality_report(df).first().n_words == 2


def test_smallest_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert ours(spark, rows, quality.LINE_LIMIT) == plain(rows, quality.LINE_LIMIT)
