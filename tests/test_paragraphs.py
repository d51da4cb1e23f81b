"""Lines, paragraph rows and markup."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions.text import escape_markup, split_lines, trim_runs, unescape_markup
from sheaf.operators.markup import (
    assemble_bundle,
    header_markup,
    parse_markup,
    read_header,
    render_paragraphs,
    wrap_body,
)
from sheaf.plans.unpack import unpack
from sheaf.operators.paragraphs import as_stream, build_paragraphs, explode_lines, is_heading

LINES = {
    "": [], "a": ["a"], "a\n": ["a"], "a\n\n": ["a", ""], "\n": [""], "a\r\nb": ["a", "b"], "a\r": ["a\r"],
    "a\r\r\nb\r\n": ["a\r", "b"], "\n\na": ["", "", "a"], "a\rb": ["a\rb"], "\r\n": [""],
}


def values(spark, items, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_split_lines(spark):
    assert values(spark, LINES, split_lines) == list(LINES.values())


def texts(spark, rows):
    return spark.createDataFrame(rows, "bundle_id string, source_ord int, path string, text string")


def test_rows_of_files(spark):
    df = texts(spark, [("b", 0, "a\\x.txt", "1\n\n2\n"), ("b", 0, "empty", ""), ("b", 1, "null", None)])
    got = [(r.path, r.line_no, r.style, r.text) for r in build_paragraphs(df).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == [
        ("a\\x.txt", 0, "Heading1", "a/x.txt"), ("a\\x.txt", 1, None, "1"), ("a\\x.txt", 2, None, ""),
        ("a\\x.txt", 3, None, "2"), ("empty", 0, "Heading1", "empty"), ("null", 0, "Heading1", "null"),
    ]
    assert explode_lines(df.select("path", "text")).count() == 3
    assert as_stream(build_paragraphs(df)).columns == ["bundle_id", "position", "style", "text"]
    plan = build_paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_any_heading_style_counts(spark):
    got = values(spark, ["Heading1", "Heading9", "Title", "SubHeading", None, ""], is_heading)
    assert got == [True, True, False, False, False, False]


def test_escape_and_back(spark):
    raw = ["a & b <c> \"d\" 'e'", "x\r\ty\nz", "&amp;", "\x00\x01\x0b\x0c\x1f", "&#xD;"]
    want = ["a &amp; b &lt;c&gt; &quot;d&quot; &apos;e&apos;", "x&#xD;\ty\nz", "&amp;amp;", "", "&amp;#xD;"]
    assert values(spark, raw, escape_markup) == want
    back = values(spark, raw, lambda t: unescape_markup(escape_markup(t)))
    assert back == raw[:3] + [""] + raw[4:]
    assert values(spark, ["a &nosuch; b", "1 & 2"], unescape_markup) == ["", ""]


def test_trim_runs(spark):
    assert values(spark, ["  a \n\t b\t\n\n c", "\ra "], trim_runs) == ["a\nb\n\nc", "\ra"]


def test_fragments(spark):
    df = spark.createDataFrame([("b", "Heading1", "x<y"), ("b", None, "1\n2"), ("b", None, "")], "bundle_id string, style string, text string")
    got = [r.fragment for r in render_paragraphs(df).collect()]
    assert got == [
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>x&lt;y</w:t></w:r></w:p>',
        "<w:p><w:r><w:t>1</w:t></w:r><w:br/><w:r><w:t>2</w:t></w:r></w:p>",
        "<w:p><w:r><w:t></w:t></w:r></w:p>",
    ]


@pytest.mark.parametrize("lines,size", [(10**6, 10**9), (2, 10**9), (10**6, 1), (3, 90)])
def test_runs_of_any_size_read_back_the_same(spark, lines, size):
    rows = [("small", 0, "a", "x"), ("large", 0, "b", "1\n2\n3\n\n5"), ("large", 0, "a", " y"), ("large", 1, "A", "")]
    paragraphs = build_paragraphs(texts(spark, rows))
    bodies = assemble_bundle(paragraphs, run_lines=lines, run_bytes=size)
    assert bodies.count() == 4 or size < 10**9 or lines < 10**6
    got = bodies.orderBy("bundle_id", "source_ord", "path", "first_line").collect()
    one = assemble_bundle(paragraphs).orderBy("bundle_id", "source_ord", "path").collect()
    assert "".join(r.body for r in got) == "".join(r.body for r in one)
    back = parse_markup(bodies)
    assert sorted(map(tuple, back.select(paragraphs.columns).collect()), key=repr) == sorted(map(tuple, paragraphs.collect()), key=repr)
    files = {(r.bundle_id, r.path): r.content for r in unpack(back).collect()}
    assert files == {("small", "a"): "x", ("large", "b"): "1\n2\n3\n\n5", ("large", "a"): " y", ("large", "A"): ""}


def test_runs_are_read_one_by_one(spark):
    run = "<w:r><w:t>{}</w:t></w:r>"
    cases = {
        run.format("x &nosuch; y") + "<w:br/>" + run.format("keep"): "\nkeep",
        run.format("&#66;&#x1f600;&amp;#67;") + "out<w:tab/>": "B\U0001f600&#67;\t",
        run.format("&#0;") + run.format("&#xD800;") + run.format("a") + run.format("&#1114112;"): "a",
        "<w:r><w:t xml:space='preserve'> a </w:t></w:r>" + run.format("&lt;&amp;lt;"): " a <&lt;",
    }
    df = spark.createDataFrame([(f"<w:p>{c}</w:p>",) for c in cases], "body string")
    assert sorted(r.text for r in parse_markup(df).collect()) == sorted(cases.values())


def test_parsing_stops_quietly(spark):
    body = wrap_body(F.col("b"))
    good = "<w:p><w:r><w:t>1</w:t></w:r><w:tab/></w:p>"
    cases = [good + good, good + "<w:p><w:r><w:t>cut", good + "<oops>" + good, "", "<w:p></w:p>"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b string")
    got = parse_markup(df.select("i", body.alias("body"))).groupBy("i").agg(F.collect_list("text").alias("t"))
    assert {r.i: r.t for r in got.collect()} == {0: ["1\t", "1\t"], 1: ["1\t"], 2: ["1\t"], 4: [""]}


def test_headers(spark):
    df = spark.createDataFrame([("a & b",), ("",), (None,)], "h string")
    got = df.select(read_header(header_markup(F.col("h"))).alias("h")).collect()
    assert [r.h for r in got] == ["a & b", None, None]
