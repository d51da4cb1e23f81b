"""Is this text? Expressions over the first 8,192 bytes of a file.

Bytes are looked at as the characters of the same numbers: one regex pass takes runs of whole units,
keeps those that count and drops the others, so a length gives the count and no array is built. Only
content with a zero byte can be wide text, so other files skip that part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.binding import let
from sheaf.functions.charsets import bom_charset, ladder, strict_decode

# Prefix read, and windows of the wide-text tests in units and bytes.
SNIFF_BYTES = 8192
UTF16_UNITS = 4096
UTF32_UNITS = 2048
PRINTABLE_BYTES = 4096


def sniff_prefix(content: Column) -> Column:
    return F.substring(content, 1, SNIFF_BYTES)


def has_bom(head: Column) -> Column:
    return bom_charset(head).isNotNull()


def has_nul(head: Column) -> Column:
    return F.contains(head, F.unhex(F.lit("00")))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _count(data: Column, unit: str, width: int) -> Column:
    """How many units of ``width`` bytes match the regex ``unit``."""
    other = f"(?:(?!{unit}).{{{width}}})++"
    kept = F.regexp_replace(_latin(data), f"(?s)((?:{unit})++)|{other}|.", "$1")
    return (F.char_length(kept) / width).cast("int")


def utf16_scores(head: Column) -> tuple[Column, Column]:
    """Units that look like a Latin character, read low byte first and high byte first."""
    window = F.substring(head, 1, UTF16_UNITS * 2)
    return _count(window, r"[^\x00]\x00", 2), _count(window, r"\x00[^\x00]", 2)


# Bytes that print in ASCII, its white space included.
_PRINTABLE = r"[!-~ \t\n\f\r]"


def looks_utf16(head: Column) -> Column:
    """Two-byte text without a mark: one byte order clearly leads, decodes cleanly and prints."""
    size = F.octet_length(head)
    units = F.least((size / 2).cast("int"), F.lit(UTF16_UNITS))
    enough = F.floor(F.least(size, F.lit(PRINTABLE_BYTES)) / 4)
    start = F.substring(head, 1, PRINTABLE_BYTES)

    # Plain units and whole surrogate pairs go first, so a surrogate that is kept stands alone.
    def clean(plain: str, pair: str, lone: str) -> Column:
        return F.regexp_replace(_latin(head), f"(?s)(?:{plain})++|{pair}|({lone})|.", "$1") == ""

    little = clean(
        r".[^\xD8-\xDF]", r".[\xD8-\xDB].[\xDC-\xDF]", r".[\xD8-\xDF]"
    ) & (_count(start, f"{_PRINTABLE}.", 2) > enough)
    big = clean(
        r"[^\xD8-\xDF].", r"[\xD8-\xDB].[\xDC-\xDF].", r"[\xD8-\xDF]."
    ) & (_count(start, f".{_PRINTABLE}", 2) > enough)

    def verdict(s: Column) -> Column:
        leads = F.when(s["le"] > s["be"] * 5, little).when(s["be"] > s["le"] * 5, big)
        return (s["le"] + s["be"] >= F.floor(units / 4)) & F.coalesce(leads, F.lit(False))

    le, be = utf16_scores(head)
    scores = F.struct(le.alias("le"), be.alias("be"))
    return F.when((size >= 4) & (size % 2 == 0), let(scores, verdict)).otherwise(False)


def utf32_scores(head: Column) -> tuple[Column, Column]:
    window = F.substring(head, 1, UTF32_UNITS * 4)
    return _count(window, r"[^\x00]\x00{3}", 4), _count(window, r"\x00{3}[^\x00]", 4)


def looks_utf32(head: Column) -> Column:
    size = F.octet_length(head)
    units = F.least((size / 4).cast("int"), F.lit(UTF32_UNITS))

    def verdict(s: Column) -> Column:
        leads = (s["le"] > s["be"] * 3) | (s["be"] > s["le"] * 3)
        return (s["le"] + s["be"] > F.floor(units / 4)) & leads

    le, be = utf32_scores(head)
    scores = F.struct(le.alias("le"), be.alias("be"))
    return F.when((size >= 8) & (size % 4 == 0), let(scores, verdict)).otherwise(False)


# Code points of meaningful text. Left out are controls but TAB, LF, FF and CR, the
# replacement character, and noncharacters; those at the end of every plane follow a rule.
GOOD_BASIC = r"[\t\n\f\r -~\xA0-\uFDCF\uFDF0-\uFFFC]"
GOOD_PLANES = "[" + "".join(f"\\x{{{p:X}0000}}-\\x{{{p:X}FFFD}}" for p in range(1, 17)) + "]"


def bad_chars(text: Column) -> Column:
    """Characters left when runs of good ones are taken out, a whole text in one match as a rule."""
    return F.char_length(F.regexp_replace(text, f"{GOOD_BASIC}++|{GOOD_PLANES}++", ""))


def is_meaningful(text: Column) -> Column:
    """At most one character in ten is bad; empty text is fine."""
    return bad_chars(text) * 10 <= F.char_length(text)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def utf8_lossy(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def sniff_reason(content: Column, encodings: Sequence[str] = ()) -> Column:
    """The first test that settles the question; see :func:`is_text_reason` for its verdict."""

    def wide_or_nul(head: Column) -> Column:
        return F.when(looks_utf16(head), "utf16").when(looks_utf32(head), "utf32").otherwise("nul")

    def chain(head: Column) -> Column:
        reason = (
            F.when(head.isNull(), "unreadable")
            .when(F.octet_length(head) == 0, "empty")
            .when(has_bom(head), "bom")
            .when(has_nul(head), wide_or_nul(head))
            .when(is_utf8(head) & is_meaningful(head.cast("string")), "utf8")
        )
        for label, charset in ladder(encodings):
            decoded = let(strict_decode(head, charset), lambda t: t.isNotNull() & is_meaningful(t))
            reason = reason.when(decoded, label)
        lossy = let(utf8_lossy(head), is_meaningful)
        return reason.when(lossy, "lossy").otherwise("binary")

    return let(sniff_prefix(content), chain)


def is_text_reason(reason: Column) -> Column:
    return ~reason.isin("unreadable", "nul", "binary")
