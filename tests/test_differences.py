"""Reasons of differences, against lists of lines."""

import random

import pytest

from sheaf.operators import differences
from sheaf.operators.differences import explain_diff


def plain(before, after):
    def lines(text):
        out = text.replace("\r\n", "\n").split("\n")
        while out and out[-1] == "":
            out.pop()
        return out

    def ends(rows):
        while rows and rows[-1] == "":
            rows = rows[:-1]
        return rows

    if before is None or after is None:
        return ("added" if before is None else "missing", None, None)
    b, a = lines(before), lines(after)
    if a == b:
        return "same", None if before.rstrip("\n") == after.rstrip("\n") else "line_ends", None
    n = next(i for i in range(max(len(a), len(b))) if (a[i : i + 1] or [""]) != (b[i : i + 1] or [""])) + 1
    bare = lambda rows: [x.strip(" \t") for x in rows]
    full = lambda rows: [x for x in rows if x.strip(" \t")]
    if ends(bare(a)) == ends(bare(b)):
        return "changed", "outer_blanks", n
    if full(a) == full(b):
        return "changed", "blank_lines", n
    return "changed", "blanks" if bare(full(a)) == bare(full(b)) else "content", n


def edited(rnd, text):
    rows = text.split("\n")
    for _ in range(rnd.randrange(3)):
        i = rnd.randrange(len(rows) + 1)
        what = rnd.randrange(7)
        if what == 0:
            rows.insert(i, "")
        elif what == 1:
            rows.insert(i, " \t")
        elif i < len(rows):
            rows[i] = {2: rows[i] + " ", 3: "\t" + rows[i], 4: rows[i] + "\r", 5: rows[i] + "!", 6: ""}[what]
    return "\n".join(rows)


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_reasons_and_first_lines(spark, monkeypatch, width):
    monkeypatch.setattr(differences, "RANGE", width)
    rnd = random.Random(width)
    before, after = {}, {}
    for i in range(250):
        text = "\n".join(rnd.choice(["", "a", "b", " c", "d\r", "e", "e"]) for _ in range(rnd.randrange(12))) + rnd.choice(["", "\n", "\n\n"])
        if rnd.random() < 0.95:
            before[f"f{i}"] = text
        if rnd.random() < 0.95:
            after[f"f{i}"] = edited(rnd, text)
    b = spark.createDataFrame([("b", p, t) for p, t in before.items()] + [("b", "f0", None)][: "f0" not in before], "bundle_id string, path string, text string")
    parts = []
    for p, t in after.items():
        rows, at = t.split("\n"), 0
        while at < len(rows) or at == 0:  # files come in parts of a few lines, in any order
            size = rnd.randrange(1, 5)
            parts.append(("b", p, 0 if at == 0 else at + 1, "\n".join(rows[at : at + size])))
            at += size
    rnd.shuffle(parts)
    # Parts are joined with a line feed, so a carriage return at the end of one has its feed only in the whole.
    parts = [x for x in parts if "\r" not in x[3]] + [("b", p, 0, t) for p, t in after.items() if "\r" in t]
    whole = {p for p, t in after.items() if "\r" in t}
    parts = [x for x in parts if x[1] not in whole or x[3] == after[x[1]]]
    a = spark.createDataFrame(parts, "bundle_id string, path string, part_no bigint, content string").dropDuplicates()
    got = {r.path: (r.status, r.reason, r.first_line) for r in explain_diff(b, a).collect()}
    want = {p: plain(before.get(p), after.get(p)) for p in {**before, **after}}
    assert {p: got.get(p) for p in want} == want
    assert len({x[1] for x in want.values()}) == 6


def test_a_repeated_path_counts_once(spark):
    b = spark.createDataFrame([("b", "f", 1, "x\ny"), ("b", "./f", 2, "x\nz"), ("b", "e", 1, "")], "bundle_id string, path string, ord int, text string")
    a = spark.createDataFrame([("b", "f", "x\nz "), ("b", "e", "\n")], "bundle_id string, path string, content string")
    assert sorted(tuple(r) for r in explain_diff(b, a).collect()) == [("b", "e", "same", None, None), ("b", "f", "changed", "outer_blanks", 2)]
    assert explain_diff(b.limit(0), a.limit(0)).collect() == []
