"""Path expressions: parts, parents, and the check of a heading before it becomes a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.binding import let
from sheaf.functions.text import forward_slashes, trim_space

# Device names no file may bear, and characters no file name may hold.
RESERVED_NAMES = (
    "CON PRN AUX NUL "
    "COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 "
    "LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9"
).split()
FORBIDDEN_CHARS = '<>:"|?*\x00'

# A name with something before its last dot splits there; a leading dot alone starts no extension.
_STEM_EXT = r"(?s)\A(.+)\.([^.]*)\z"


def components(path: Column) -> Column:
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.element_at(components(F.regexp_replace(path, r"/+\z", "")), -1)


def extension(path: Column) -> Column:
    """Extension without its dot; null where the name has none."""
    name = base_name(path)
    return F.when(name.rlike(_STEM_EXT) & (name != ".."), F.regexp_extract(name, _STEM_EXT, 2))


def stem(path: Column) -> Column:
    name = base_name(path)
    split = name.rlike(_STEM_EXT) & (name != "..")
    return F.when(split, F.regexp_extract(name, _STEM_EXT, 1)).otherwise(name)


def parent(path: Column) -> Column:
    """Directory part; empty for a bare name, ``/`` for a name right below the root."""
    clean = F.regexp_replace(path, r"(?<=.)/+\z", "")
    cut = F.regexp_extract(clean, r"(?s)\A(.*)/[^/]*\z", 1)
    return F.when((cut == "") & clean.startswith("/"), F.lit("/")).otherwise(cut)


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^/|^[A-Za-z]:(?:/|\z)")


def has_traversal(path: Column) -> Column:
    return F.array_contains(components(path), "..")


def is_reserved(component: Column) -> Column:
    return F.upper(F.regexp_replace(component, r"(?s)\.[^.]*\z", "")).isin(RESERVED_NAMES)


def replace_forbidden(path: Column) -> Column:
    return F.translate(path, FORBIDDEN_CHARS, "_" * len(FORBIDDEN_CHARS))


_SUSPECT = r"(?i)(?:^|/)(?:\.\.|(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.[^./]*)?)(?:/|\z)"


def validate_heading(heading: Column) -> Column:
    """Struct (path, error): error is empty, absolute, traversal or reserved, decided left to right."""

    def check(path: Column) -> Column:
        bad = F.get(F.filter(components(path), lambda c: (c == "..") | is_reserved(c)), F.lit(0))
        kind = F.when(bad == "..", "traversal").when(bad.isNotNull(), "reserved")
        # Most headings have no such component, so a cheap look comes before the split.
        error = (
            F.when(path == "", "empty")
            .when(is_absolute(path), "absolute")
            .when(path.rlike(_SUSPECT), kind)
        )
        return let(
            error,
            lambda e: F.struct(F.when(e.isNull(), replace_forbidden(path)).alias("path"), e.alias("error")),
        )

    return let(forward_slashes(trim_space(heading)), check)


def file_identity(path: Column) -> Column:
    """Equal for paths that name one file: empty and ``.`` components count for nothing."""
    kept = F.filter(components(path), lambda c: (c != "") & (c != "."))
    odd = path.rlike(r"(?:^|/)\.?(?:/|\z)")
    return F.when(odd, F.array_join(kept, "/")).otherwise(path)
