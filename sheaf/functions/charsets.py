"""Decoding with a ladder of encodings.

Build these expressions inside :func:`sheaf.session.java_charsets`.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.binding import let

# The encodings tried when none are given.
DEFAULT_ENCODINGS = ("UTF-8", "GBK", "SHIFT_JIS", "EUC-KR")

# Web labels of the multi-byte decoders, by JVM charset.
MULTI_BYTE = {
    "GB18030": "chinese csgb2312 csiso58gb231280 gb18030 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "Big5-HKSCS": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "windows-31j": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "x-windows-949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "UTF-16BE": "unicodefffe utf-16be",
    "UTF-16LE": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
}

# Web labels of the single-byte decoders beside the regular ones (see _regular), by Python codec.
SINGLE_BYTE = {
    "cp866": "866 cp866 csibm866 ibm866",
    "iso8859_2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso8859_3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso8859_4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso8859_5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso8859_6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso8859_7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso8859_8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual csiso88598i iso-8859-8-i logical",
    "iso8859_10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso8859_13": "",
    "iso8859_14": "",
    "iso8859_15": "csisolatin9 iso_8859-15 l9",
    "iso8859_16": "iso-8859-16",
    "koi8_r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8_u": "koi8-ru koi8-u",
    "mac_roman": "csmacintosh mac macintosh x-mac-roman",
    "mac_cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1250": "",
    "cp1251": "",
    "cp1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "cp1253": "",
    "cp1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "cp1255": "",
    "cp1256": "",
    "cp1257": "",
    "cp1258": "",
    "x-user-defined": "x-user-defined",
}

# Bytes that the web reads otherwise than the codec.
OVERRIDES = {
    "koi8_u": {0xAE: 0x045E, 0xBE: 0x040E},
    "mac_cyrillic": {0xA2: 0x0490, 0xB6: 0x0491, 0xFF: 0x20AC},
    "cp1255": {0xCA: 0x05BA},
}

# Labels of UTF-8, which is tried before any ladder, and of the decoder that refuses all bytes.
UTF8_LABELS = "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8"
REFUSED_LABELS = "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement"

MARK = "\ufffd"


def _regular(codec: str) -> list[str]:
    """Labels that follow from a codec's family and number."""
    if codec.startswith("iso8859_") and codec != "iso8859_16":
        n = codec.removeprefix("iso8859_")
        return [f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}"] + [f"iso_8859-{n}"] * (len(n) == 1)
    if codec.startswith("cp125"):
        return [codec, f"windows-{codec[2:]}", f"x-{codec}"]
    return []


def upper_half(codec: str) -> str:
    """What the bytes 80 to FF of a single-byte charset mean, U+FFFD where they mean nothing.

    Bytes 80 to 9F that a Windows code page leaves open are the control characters of their numbers.
    """
    if codec == "x-user-defined":
        return "".join(chr(0xF700 + b) for b in range(0x80, 0x100))
    windows = codec == "cp874" or codec.startswith("cp125")
    out = []
    for b in range(0x80, 0x100):
        char = bytes([b]).decode(codec, "replace")
        if char == MARK and windows and b < 0xA0:
            char = chr(b)
        out.append(chr(OVERRIDES.get(codec, {}).get(b, ord(char))))
    return "".join(out)


LABELS = {**MULTI_BYTE, **{codec: " ".join([*_regular(codec), *more.split()]) for codec, more in SINGLE_BYTE.items()}}
CHARSETS = {label: charset for charset, labels in LABELS.items() for label in labels.split()}



def ladder(encodings: Sequence[str]) -> list[tuple[str, str]]:
    """(label, charset) of the encodings to try; UTF-8 is tried before them, unknown ones never, with a warning."""
    known = [(e.strip().upper(), CHARSETS.get(e.strip().lower())) for e in encodings]
    passed = {*UTF8_LABELS.split(), *REFUSED_LABELS.split()}
    missing = [label for label, charset in known if not charset and label.lower() not in passed]
    if missing:
        warnings.warn(f"encodings skipped, no decoder known: {', '.join(missing)}", stacklevel=2)
    return [(label, charset) for label, charset in known if charset]


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _single(content: Column, codec: str) -> Column:
    """Every byte by the table of its charset."""
    pairs = [(chr(0x80 + i), c) for i, c in enumerate(upper_half(codec)) if c != chr(0x80 + i)]
    return F.translate(_latin(content), "".join(a for a, _ in pairs), "".join(c for _, c in pairs))


# Noncharacters, which no byte is in the Latin-1 view: between the two bytes of a character, and for a lone byte 80.
_WITHIN, _LONE = "\ufffe", "\uffff"
# First and second bytes of two-byte characters. The byte 80 can only be second.
_PAIRS = {
    "GB18030": r"([\x81-\xFE])([\x40-\x7E\x80-\xFE])",
    "windows-31j": r"([\x81-\x9F\xE0-\xFC])([\x40-\x7E\x80-\xFC])",
}


def _multi(content: Column, charset: str) -> Column:
    """By the JVM's charset; the byte 80 that stands alone is a euro sign in Chinese, a control in Japanese text,
    where the JVM finds no meaning."""
    whole = F.decode(content, charset)
    if charset not in _PAIRS:
        return whole
    # Characters are found one after the other, so the first bytes are told from second ones.
    told = F.regexp_replace(_latin(content), _PAIRS[charset], f"$1{_WITHIN}$2")
    lone = F.translate(F.regexp_replace(told, rf"(?<!{_WITHIN})\x80", _LONE), _WITHIN, "")

    def mended(t: Column) -> Column:
        if charset == "GB18030":
            as_pair = F.replace(t, F.lit(_LONE), F.lit("\xa2\xe3"))  # the euro sign in two bytes
            return F.decode(F.encode(as_pair, "ISO-8859-1"), charset)
        pieces = F.transform(F.split(t, _LONE, -1), lambda p: F.decode(F.encode(p, "ISO-8859-1"), charset))
        return F.array_join(pieces, "\x80")

    return F.when(F.contains(content, F.unhex(F.lit("80"))), let(lone, mended)).otherwise(whole)


def strict_decode(content: Column, charset: str) -> Column:
    """Decoded text, or null if a byte was bad. Charsets are those of LABELS, or the JVM's."""
    text = _single(content, charset) if charset in SINGLE_BYTE else _multi(content, charset)
    return let(text, lambda t: F.when(~F.contains(t, F.lit(MARK)), t))


# Byte-order marks as hex, with the charset of what follows.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def bom_charset(content: Column) -> Column:
    """Charset a byte-order mark stands for; null without a mark."""
    return let(
        F.hex(F.substring(content, 1, 3)),
        lambda lead: F.coalesce(*(F.when(lead.startswith(m), F.lit(c)) for m, c in MARKS)),
    )


def _decode_marked(content: Column, charset: Column) -> Column:
    def after(mark: str) -> Column:
        return F.substring(content, len(mark) // 2 + 1, 2147483647)

    return F.coalesce(*(F.when(charset == c, strict_decode(after(m), c)) for m, c in MARKS))


def _result(text: Column, encoding: str | Column) -> Column:
    label = encoding if isinstance(encoding, Column) else F.lit(encoding)
    return F.struct(text.alias("text"), label.alias("encoding"))


def _if_decoded(text: Column, encoding: str) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), _result(t, encoding)))


def decode_with(content: Column, encodings: Sequence[str], wide: Column | None = None) -> Column:
    """Struct (text, encoding): strict UTF-8, then the ladder, then UTF-8 with marks for bad bytes.

    A byte-order mark overrides the charsets of the ladder, which then all give the same. ``wide``
    optionally names a wide encoding found by sniffing (null otherwise) to use first.
    """
    tries = ladder(encodings)

    def chain(c: Column) -> Column:
        as_text = c.cast("string")
        lossy = _result(F.make_valid_utf8(as_text), "UTF-8-LOSSY")
        steps = [_if_decoded(strict_decode(c, charset), label) for label, charset in tries]
        rest = F.coalesce(*steps, lossy)
        if tries:
            plain, label = rest, tries[0][0]
            rest = let(
                bom_charset(c),
                lambda mark: F.when(mark.isNull(), plain).otherwise(
                    F.coalesce(_if_decoded(_decode_marked(c, mark), label), lossy)
                ),
            )
        valid = F.when(F.is_valid_utf8(as_text), _result(as_text, "UTF-8")).otherwise(rest)
        return F.when(c.isNotNull(), valid)

    decoded = let(content, chain)
    if wide is None:
        return decoded
    names = ("UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE")
    found = (F.when(wide == n, _result(F.decode(content, n), n)) for n in names)
    return F.coalesce(*found, decoded)
