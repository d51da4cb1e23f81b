import random
from collections import defaultdict
from itertools import combinations

import pytest

from sheaf.llm import lines, minhash, near

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def prose(r, n, vocabulary=4000):
    return " ".join(r.choice(["Th", "ou", "ré", "日本", "ing"]) + str(r.randrange(vocabulary)) for _ in range(n))


def edited(r, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def plain_lines(rows, threshold=0.8):
    found, place = [], {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            t = line.strip(" \t\x0b\f\r").translate(LOW)
            if t:
                found.append((doc, n, t))
    sets = {t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} for _, _, t in found}
    c = Classes()
    for x, y in combinations(sorted(sets), 2):
        both = len(sets[x] & sets[y])
        if both and both >= threshold * (len(sets[x]) + len(sets[y]) - both):
            c.link(x, y)
    for doc, n, t in found:
        k = c.find(t)
        place[k] = min(place.get(k, (doc, n)), (doc, n))
    return sorted((doc, n, *place[c.find(t)], (doc, n) == place[c.find(t)]) for doc, n, t in found)


def line_docs(seed, docs=60):
    r = random.Random(seed)
    stock = [prose(r, r.choice([1, 2, 6, 20, 40])) for _ in range(12)]
    rows = []
    for i in range(docs):
        parts = [prose(r, r.choice([0, 1, 8, 30])) for _ in range(r.randrange(4))]
        parts += [r.choice([x, x.upper().lower(), f"  {x}\t", edited(r, x, 1)]) for x in r.sample(stock, 2)]
        r.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    return [*rows, (90, rows[3][1]), (91, ""), (92, None), (93, " \n\t\n"), (94, "ab"), (95, "AB\nab"), (96, "x" * 30_000), (97, "x" * 30_000 + "y")]


@pytest.mark.parametrize("seed", [1])
def test_lines_equal_to_plain_classes(spark, seed):
    rows = line_docs(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in lines.line_report(df).select("doc_id", "line_no", "class_doc_id", "class_line_no", "keep").collect())
    assert got == plain_lines(rows)


def test_lines_taken_out(spark):
    rows = [(i, t, "s", i) for i, t in line_docs(3)]
    rows += [(100, "only here and twice given", "s", 1)] * 2 + [(None, "a null id\nkeeps its line", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t1 string, n int").repartition(3)
    got = defaultdict(list)
    for r in lines.dedup_lines(df).collect():
        got[r.doc_id].append(r.text)
    stays = {(d, n) for d, n, _, _, keep in plain_lines([r[:2] for r in rows if r[0] is not None][:-2] + [(100, rows[-2][1])]) if keep}
    for doc, text, _, _ in rows[:-3]:
        pieces = (text or "").split("\n")
        left = [x for n, x in enumerate(pieces) if not x.strip(" \t\x0b\f\r") or (doc, n) in stays]
        if text and any(x.strip() for x in pieces):
            assert got.get(doc, []) == (["\n".join(left)] if any(x.strip() for x in left) else [])
        else:
            assert got[doc] == [text]
    assert got[100] == ["only here and twice given"] and got[None] == [rows[-1][1]]


def weighted(rows, threshold=0.8):
    """Classes by weighted Jaccard similarity on exact sets, weights taken from the operator's cells."""
    import numpy as np
    import pyarrow as pa

    from sheaf.llm.arrays import slices

    texts = sorted({t for _, t in rows if t and t.split()})
    held, sets = np.zeros(minhash.CELLS), {}
    for t in (t for _, t in rows if t):
        for s in slices(pa.array([t])):
            held += np.bincount(minhash.cell(minhash.shingle_sets(s)[1]), minlength=minhash.CELLS)
    idf = (1 + np.maximum(np.log((len(rows) + 1) / (held + 1)), 0)).astype(np.float32)
    for t in texts:
        w = t.translate(LOW).split()
        plain = defaultdict(int)
        for i in range(max(1, len(w) - 4)):
            plain[tuple(w[i : i + 5])] += 1
        (s,) = slices(pa.array([t]))
        _, gram, count = minhash.shingle_sets(s)
        assert sorted(plain.values()) == sorted(count.tolist())
        sets[t] = (gram, count * idf[minhash.cell(gram)])
    c = Classes()
    near_edge = False
    for x, y in combinations(texts, 2):
        j = near.jaccard(sets[x], sets[y])
        near_edge |= abs(j - threshold) < 1e-4
        if j >= threshold:
            c.link(x, y)
    assert not near_edge
    first = {}
    for doc, t in rows:
        if t in sets:
            first[c.find(t)] = min(first.get(c.find(t), doc), doc)
    return sorted((doc, first[c.find(t)] if t in sets else doc) for doc, t in rows)


def doc_rows(seed):
    r = random.Random(seed)
    rows = [(i, prose(r, r.choice([1, 3, 5, 60, 200]))) for i in range(60)]
    base, far = prose(r, 150), prose(r, 400)
    rows += [(100 + i, edited(r, base, r.choice([1, 2, 3, 5, 9]))) for i in range(150)]
    chain = far
    for i in range(12):
        chain = edited(r, chain, 4)
        rows.append((300 + i, chain))
    rows += [(400 + i, base) for i in range(9)]
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  TWO"), (505, "w " * 60_000), (506, "w " * 60_001)]


@pytest.mark.parametrize("seed", [1])
def test_documents_equal_to_plain_classes(spark, seed):
    rows = doc_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = minhash.class_report(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == weighted(rows)
    assert all(r.keep == (r.doc_id == r.class_id) for r in got)


def test_one_of_each_class_stays(spark):
    rows = [(i, t, "x") for i, t in doc_rows(3)] + [(600, "the same row twice is one row", "y")] * 2 + [(None, "a null id stays too", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a string").repartition(3)
    want = sorted({c for _, c in weighted([r[:2] for r in rows[:-3]])})
    got = [r.doc_id for r in minhash.drop_near_duplicates(df).collect()]
    assert sorted(x for x in got if x not in (600, None)) == want
    assert got.count(600) == 1 and got.count(None) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.line_report(df).count() == lines.dedup_lines(df).count() == 0
    assert minhash.class_report(df).count() == minhash.drop_near_duplicates(df).count() == 0


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(70)] + [(200, 200 + i) for i in range(1, 60)] + [(500, 500)]
    edges += [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    c = Classes()
    for x, y in edges:
        c.link(x, y)
    df = spark.createDataFrame([(x, -x, y, -y) for x, y in edges], "a bigint, b bigint, pa bigint, pb bigint")
    got = {r.a: r.la for r in near.components(df).collect()}
    assert got == {x: c.find(x) for x in c.up if x != 500}


def test_blocks_find_what_hubs_leave(spark):
    """Members of one bucket, links far from its hub, blocks of two."""
    import numpy as np

    texts = {1: "abcde", 2: "fghij", 3: "fghijk", 4: "lmnop", 5: "lmnopq", 6: "rst"}
    nodes = spark.createDataFrame([(i, i, [7]) for i in texts], "a bigint, b bigint, bands array<bigint>")
    content = spark.createDataFrame([(i, i, bytearray(t.encode())) for i, t in texts.items()], "a bigint, b bigint, content binary")

    def read(contents):
        ids = [np.unique(np.frombuffer(x, np.uint8)).astype(np.uint64) for x in contents]
        return [(x, np.ones(len(x), np.float32)) for x in ids]

    got = near.near_classes(spark, nodes, lambda wanted: content, read, 0.8, block=2)
    assert sorted((r.a, r.la) for r in got.collect()) == [(2, 2), (3, 2), (4, 4), (5, 4)]


def test_stars_take_one_round(spark, monkeypatch):
    """Labels found before are stars; no round is spent on seeing that they do not change."""
    tables, plain = [], near.written
    monkeypatch.setattr(near, "written", lambda df, label: tables.append(label) or plain(df, label))
    links = [(i, 0, 7 * (i // 10), 0) for i in range(1000, 1100) if i % 10] + [(700, 0, 700, 0)]
    got = near.components(spark.createDataFrame(links, "a bigint, b bigint, pa bigint, pb bigint")).collect()
    assert tables.count("stars") == 2
    assert {(r.a, r.la) for r in got} == {(a, p) for a, _, p, _ in links[:-1]} | {(p, p) for _, _, p, _ in links[:-1]}


def test_small_groups_are_read_together():
    import pyarrow as pa

    calls = []

    def read(contents):
        calls.append(len(contents))
        return lines.read_lines(contents)

    group = pa.RecordBatch.from_pydict({"la": [1, 2], "lb": [0, 0], "own": [0, 0], "content": [b"a line of text", b"a line of text!"]})
    same = pa.RecordBatch.from_pydict({"la": [1, 1], "lb": [0, 0], "own": [0, 0], "content": [b"x", b"y"]})
    found = list(near._read_groups(iter([group, same] * 300), read))
    assert len(calls) == 1 and len(found) == 300
    assert all(near._links(g, sets, 0.8) == ([0], [1]) for g, sets in found)
    calls.clear()
    large = pa.RecordBatch.from_pydict({"la": [1, 2], "lb": [0, 0], "own": [0, 0], "content": [b"z" * near.READ_BYTES] * 2})
    assert len(list(near._read_groups(iter([large] * 3), read))) == 3 and calls == [2, 2, 2]


def test_signatures_do_not_hang_on_stretches(monkeypatch):
    import numpy as np

    h = np.random.default_rng(3).integers(0, 1 << 62, 5_000, dtype=np.uint64)
    begin = np.array([0, 1, 2, 1_500, 1_501, 4_900, 4_999])
    whole, sizes, plain = lines.signatures(h, begin), [], np.empty_like
    monkeypatch.setattr(lines, "STRETCH", 1_000)
    monkeypatch.setattr(lines.np, "empty_like", lambda x, **k: sizes.append(len(x)) or plain(x, **k))
    assert (lines.signatures(h, begin) == whole).all() and max(sizes) == 3_399  # a line is not cut
    assert lines.signatures(h[:0], begin[:0]).shape == (0, lines.BANDS)
