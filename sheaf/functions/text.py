"""Text expressions: lines, markup escaping, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode calls White_Space.
SPACE_CLASS = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def trim_space(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def split_lines(text: Column) -> Column:
    """Lines without their LF or CR LF; no line after a final LF, none at all for empty text."""
    pieces = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    # Text that ends with LF, and empty text, leave an empty piece at the end.
    surplus = (text.endswith("\n") | (text == "")).cast("int")
    return F.slice(pieces, F.lit(1), F.size(pieces) - surplus)


def trim_line_feeds(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


# Characters written as entities, the ampersand first.
ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&apos;"),
    ("\r", "&#xD;"),
)


_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def escape_markup(text: Column) -> Column:
    """Drop the control characters markup forbids (TAB, LF and CR stay), then write entities."""
    text = F.when(text.rlike(_CONTROLS), F.regexp_replace(text, _CONTROLS, "")).otherwise(text)
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# An ampersand that opens none of the entities the reader knows.
_UNKNOWN_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"
_NUMBERED = r"&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});"


def _numbered(text: Column) -> tuple[Column, Column]:
    """Text with numeric references as characters, and whether one of them names no character."""
    found = F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0))
    code = F.transform(
        found,
        lambda r: F.when(
            F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.regexp_extract(r, "x([0-9A-Fa-f]+)", 1), 16, 10)
        ).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int"),
    )
    bad = F.exists(code, lambda c: (c == 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF))
    # The four bytes of UTF-32, then decoded.
    chars = F.transform(code, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
    pieces = F.split(text, _NUMBERED, -1)
    joined = F.transform(F.arrays_zip(pieces.alias("p"), chars.alias("c")), lambda x: F.concat(x["p"], F.coalesce(x["c"], F.lit(""))))
    return F.array_join(joined, ""), bad


def unescape_markup(text: Column) -> Column:
    """Inverse of :func:`escape_markup`; numeric references are read too. A run with an entity of
    unknown name, or a number that is no character, becomes empty."""
    # Written as a number, an ampersand cannot open another entity.
    marked = F.replace(text, F.lit("&amp;"), F.lit("&#38;"))
    for char, entity in reversed(ENTITIES[1:5]):
        marked = F.replace(marked, F.lit(entity), F.lit(char))
    numbered, bad = _numbered(marked)
    plain = F.when(marked.rlike(_NUMBERED), F.when(bad, F.lit("")).otherwise(numbered)).otherwise(marked)
    return F.when(~text.contains("&"), text).when(text.rlike(_UNKNOWN_ENTITY), F.lit("")).otherwise(plain)


def trim_runs(text: Column) -> Column:
    """Trim blanks and TABs at both ends of every line inside ``text``."""
    return F.regexp_replace(text, r"(?md)^[ \t]+|[ \t]+$", "")
