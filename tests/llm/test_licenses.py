import random

import pytest

from sheaf.llm import licenses
from sheaf.llm.licenses import PHRASES, TEMPLATES, Template, key_places, word_list


def plain(rows, templates=TEMPLATES, min_cover=0.5):
    """Every template at every place of every text."""
    out = []
    for doc, text in rows:
        w = word_list(text or "")
        starts, labels, score = [], set(), 0.0
        for phrase, label in PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            if at:
                labels.add(label)
        base = set(labels)
        for t in templates:
            own, keys = word_list(t.text), key_places(t)
            for o in range(-len(own), len(w)):
                at = lambda i, o=o: w[o + i] if 0 <= o + i < len(w) else None
                if all(at(i) == own[i] for i in keys):
                    cover = sum(at(i) == x for i, x in enumerate(own)) / len(own)
                    score = max(score, cover)
                    if cover >= min_cover:
                        labels.add(t.label)
        out.append((doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def ours(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in licenses.license_report(df, **options).collect()), key=repr)


def made(seed, templates=TEMPLATES):
    """Notices whole, cut and with words exchanged, between words they use and others."""
    r = random.Random(seed)
    known = [w for t in templates for w in word_list(t.text)]
    say = lambda k: [r.choice(["été", "foo", r.choice(known)]) for _ in range(k)]
    rows = []
    for i in range(120):
        w = say(r.randrange(30))
        for _ in range(r.randrange(3)):
            own = word_list(r.choice(templates).text)
            lo = r.choice([0, 0, r.randrange(len(own))])
            own = [x if r.random() < r.choice([0.8, 0.97, 1]) else r.choice(known) for x in own[lo:]]
            w += own + say(r.randrange(20))
        rows.append((i, r.choice([" ", ", ", "\n# "]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in w)))
    return rows


@pytest.mark.parametrize("seed, anchors", [(1, 3), (2, 1), (3, 50)])
def test_equal_to_plain_search(spark, seed, anchors):
    rows = made(seed)
    rows += [(500, None), (501, ""), (502, "--- \n"), (None, "The MIT-License"), (503, "mit license"), rows[4], rows[4]]
    rows += [(600, "License 2.0 " * 40 + TEMPLATES[5].text), (601, "public license of the GNU general"), (602, "Apache license apache LICENSE")]
    got = ours(spark, rows, anchors=anchors)
    assert got == plain(rows)
    assert len({x[6] for x in got}) > 12


def test_a_key_phrase_is_mandatory(spark):
    t = Template("x", "one two three four five six seven eight", ("four five",))
    rows = [(1, "one two three four five six seven eight"), (2, "one two three four 5 six seven eight"), (3, "a four five"), (4, "one two three x four five six seven eight")]
    got = {r[0]: r[6:] for r in ours(spark, rows, templates=(t,))}
    assert got == {1: ("x", 1.0), 2: ("", 0.0), 3: ("", 0.25), 4: ("x", 0.625)}
    with pytest.raises(ValueError, match="does not stand"):
        key_places(Template("x", "a b", ("b a",)))


def test_frequencies_are_of_whole_corpus(spark):
    rows = [(i, "license license mit") for i in range(30)] + [(40, None), (41, "mit")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    n, df_of = licenses.document_frequencies(df, licenses.template_words(TEMPLATES))
    assert (n, df_of["license"], df_of["mit"], df_of["mozilla"]) == (32, 30, 31, 0)


def test_long_text(spark):
    text = "license " * 200_000 + "under the mit license " * 3 + "public " * 100_000
    (row,) = ours(spark, [(1, text)])
    assert row[1:6] == (300_012, 3, 200_002, 200_010, "mit")


def test_empty_table_and_names(spark):
    assert ours(spark, []) == []
    df = spark.createDataFrame([("mit license", 1, 2, 3)], "text string, finds int, `a.b` int, `n ``w` int")
    row = licenses.scan_licenses(df).first().asDict(recursive=True)
    assert row["places"] == [{"start": 0, "label": "mit"}] and row["a.b"] == 2 and row["n `w"] == 3 and row["text"] == "mit license"


def test_smallest_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, rows) == plain(rows)
