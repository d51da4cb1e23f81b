"""Paragraph markup: write it per file, gather it per bundle, read it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import escape_markup, trim_runs, unescape_markup
from sheaf.operators.paragraphs import is_heading

# The fragments of the markup.
BREAK = "<w:br/>"
BODY_OPEN, BODY_CLOSE = "<w:body>", "<w:sectPr></w:sectPr></w:body>"

# A run of lines ends at this many lines or bytes, so that a group and a cell stay small.
RUN_LINES = 65_536
RUN_BYTES = 32 * 1024 * 1024


def render_paragraph(style: Column, text: Column) -> Column:
    """Markup of a row: its style if it is a heading, a break between the lines inside its text."""
    runs = F.replace(
        escape_markup(text), F.lit("\n"), F.lit(f"</w:t></w:r>{BREAK}<w:r><w:t>")
    )
    styled = F.concat(F.lit('<w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr>'))
    return F.concat(
        F.lit("<w:p>"),
        F.when(is_heading(style), styled).otherwise(""),
        F.lit("<w:r><w:t>"),
        runs,
        F.lit("</w:t></w:r></w:p>"),
    )


def render_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Replace style and text by ``fragment``."""
    fragment = render_paragraph(F.col("style"), F.col("text"))
    return paragraphs.withColumn("fragment", fragment).drop("style", "text")


def assemble_bundle(
    paragraphs: DataFrame, run_lines: int = RUN_LINES, run_bytes: int = RUN_BYTES
) -> DataFrame:
    """Markup of bundles in runs: columns bundle_id, source_ord, path, first_line, body.

    A run is some lines of one file, from ``first_line`` on; it ends at ``run_lines`` lines or
    ``run_bytes`` bytes, whichever comes first. A bundle's markup is its bodies in the order of
    (source_ord, path, first_line), whatever its size, so no task sees a whole bundle or file.
    """
    block = ["bundle_id", "source_ord", "path", "block"]
    before = Window.partitionBy(*block).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    bytes_before = F.coalesce(F.sum(F.octet_length("fragment")).over(before), F.lit(0))
    rows = (
        render_paragraphs(paragraphs)
        .withColumn("block", F.floor(F.col("line_no") / run_lines))
        .withColumn("run", F.floor(bytes_before / run_bytes))
    )
    lines = F.array_sort(F.collect_list(F.struct("line_no", "fragment")))
    return (
        rows.groupBy(*block, "run")
        .agg(F.min("line_no").alias("first_line"), F.array_join(F.transform(lines, lambda r: r["fragment"]), "").alias("body"))
        .drop("block", "run")
    )


def wrap_body(body: Column) -> Column:
    """Body element around markup."""
    return F.concat(F.lit(BODY_OPEN), body, F.lit(BODY_CLOSE))


# A run's text, a break or a tab; all else between them is not text.
_TOKEN = r"(?s)<w:t(?: [^>]*)?>[^<]*</w:t>|<w:br/>|<w:tab/>"


def parse_markup(bodies: DataFrame, compat_trim: bool = False) -> DataFrame:
    """Rows of our own markup: the other columns of ``bodies`` plus seq, style and text.

    Bodies of :func:`assemble_bundle` have a ``first_line``; for them the row's ``line_no`` stands in
    its place, so the result is a paragraph table again. Paragraphs are taken one after the other
    from the start, so markup that breaks off or goes wrong ends there and keeps the rows before it.
    Nothing is shuffled: a paragraph never crosses two bodies. A run with an unknown entity is
    dropped, the rest of its paragraph stays. ``compat_trim`` trims every run, which loses indentation.
    """
    inner = F.regexp_replace("body", rf"^{BODY_OPEN}", "")
    found = F.regexp_extract_all(inner, F.lit(r"(?s)\G<w:p>(.*?)</w:p>"))
    keep = [c for c in bodies.columns if c not in ("body", "first_line")]
    place = F.col("seq").cast("bigint").alias("seq")
    first = []
    if "first_line" in bodies.columns:
        place, first = (F.col("first_line") + F.col("seq")).cast("int").alias("line_no"), ["first_line"]
    raw = bodies.select(*keep, *first, F.posexplode(found).alias("seq", "raw"))
    style = F.regexp_extract("raw", r'<w:pStyle w:val="([^"]*)"', 1)

    def text_of(token: Column) -> Column:
        body = F.regexp_extract(token, r"(?s)>([^<]*)<", 1)
        run = unescape_markup(trim_runs(body) if compat_trim else body)
        return F.when(token == BREAK, "\n").when(token == "<w:tab/>", "\t").otherwise(run)

    tokens = F.regexp_extract_all("raw", F.lit(_TOKEN), F.lit(0))
    return raw.select(
        *keep,
        place,
        F.when(style != "", unescape_markup(style)).alias("style"),
        F.array_join(F.transform(tokens, text_of), "").alias("text"),
    )


def header_markup(header: Column) -> Column:
    return F.when(header.isNotNull(), escape_markup(header))


def read_header(markup: Column) -> Column:
    """Header text; null where there is none or it is empty."""
    return F.nullif(unescape_markup(markup), F.lit(""))
