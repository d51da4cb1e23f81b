"""Why a file differs from what it was, and from which line on.

Each file is read once into fingerprints of its lines that combine over parts of a file: with their numbers by
exclusive or, as a sequence without numbers by a polynomial that goes on from part to part. Files, not their text, are
then joined. For files that changed, hashes of ranges of ``RANGE`` lines tell the first range that differs, and lines
are compared one by one in that range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.binding import let
from sheaf.functions.paths import file_identity
from sheaf.functions.text import split_lines

RANGE = 1024
# Two polynomials below 2^31, whose products stay within a long.
_PRIMES = ((2147483647, 1000003), (2147483629, 998244353))
_TRIMMED = "btrim(line, concat(' ', char(9)))"

KEY = ["bundle_id", "path"]


def _numbered(lines: str, line: str = "line") -> str:
    """Exclusive or of two hashes of every line that is not empty, with its number."""
    full = f"filter(transform({lines}, (line, i) -> struct(first + i AS n, {line} AS line)), r -> r.line <> '')"
    return f"""aggregate({full}, struct(0L AS x, 0L AS y), (a, r) ->
      struct(a.x ^ xxhash64(1, r.n, r.line) AS x, a.y ^ xxhash64(2, r.n, r.line) AS y))"""


def _sequence(line: str) -> str:
    """Lines that are not blank as two polynomials: value, and the power that shifts what comes before."""
    step = ", ".join(
        f"(a.h{i} * {b} + pmod(xxhash64({i}, l), {p})) % {p} AS h{i}, a.p{i} * {b} % {p} AS p{i}" for i, (p, b) in enumerate(_PRIMES)
    )
    start = ", ".join(f"0L AS h{i}, 1L AS p{i}" for i in range(len(_PRIMES)))
    full = f"transform(filter(lines, line -> {_TRIMMED} <> ''), line -> {line})"
    return f"aggregate({full}, struct({start}), (a, l) -> struct({step}))"


def _joined(parts: str, name: str) -> str:
    """The polynomials of parts in a row as those of the whole."""
    step = ", ".join(f"(a.h{i} * q.{name}.p{i} + q.{name}.h{i}) % {p} AS h{i}" for i, (p, _) in enumerate(_PRIMES))
    start = ", ".join(f"0L AS h{i}" for i in range(len(_PRIMES)))
    return f"aggregate({parts}, struct({start}), (a, q) -> struct({step})) AS {name}"


def _parts(df: DataFrame, text: str) -> DataFrame:
    """bundle_id, path, ord, first (number of the first line), raw and lines of every part."""
    order = F.col("ord") if "ord" in df.columns else F.lit(0)
    # Line 0 is the heading, and a part's number is that of its first row.
    first = F.greatest(F.col("part_no"), F.lit(1)) if "part_no" in df.columns else F.lit(1)
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        "bundle_id", file_identity(F.col("path")).alias("path"), order.cast("bigint").alias("ord"), first.cast("bigint").alias("first"),
        F.split(body, "\n", -1).alias("raw"), split_lines(body).alias("lines"),
    )


def _fingerprints(parts: DataFrame) -> DataFrame:
    """Per file (the one of the greatest ``ord`` where a path repeats) a struct of all fingerprints."""
    facts = parts.selectExpr(
        *KEY, "ord", "first", f"{_numbered('raw')} AS raw", f"{_numbered('lines')} AS exact", f"{_numbered('lines', _TRIMMED)} AS trimmed",
        f"{_sequence('line')} AS full", f"{_sequence(_TRIMMED)} AS bare",
    )
    sums = [F.struct(F.bit_xor(f"{n}.x").alias("x"), F.bit_xor(f"{n}.y").alias("y")).alias(n) for n in ("raw", "exact", "trimmed")]
    # A file has a part for every 64 MB or so, so the list is short.
    listed = F.array_sort(F.collect_list(F.struct("first", "full", "bare"))).alias("listed")
    files = facts.groupBy(*KEY, "ord").agg(*sums, listed)
    whole = files.selectExpr(*KEY, "ord", "raw", "exact", "trimmed", _joined("listed", "full"), _joined("listed", "bare"))
    return whole.groupBy(*KEY).agg(F.max_by(F.struct("raw", "exact", "trimmed", "full", "bare", "ord"), "ord").alias("f"))


def _first_lines(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """The first line that differs, of files in ``changed`` (key, and the ``ord`` of either side)."""

    def own(parts: DataFrame, order: str) -> DataFrame:
        return parts.join(changed.select(*KEY, F.col(order).alias("ord")), [*KEY, "ord"])

    def ranges(parts: DataFrame) -> DataFrame:
        # A range may reach over two parts; an empty line adds nothing, so files may end in any number of them.
        cut = f"""transform(filter(transform(lines, (line, i) -> struct(first + i AS n, line AS line)), r -> r.line <> ''),
          r -> struct(r.n div {RANGE} AS block, xxhash64(1, r.n, r.line) AS x, xxhash64(2, r.n, r.line) AS y))"""
        rows = parts.selectExpr(*KEY, f"inline({cut})")
        return rows.groupBy(*KEY, "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))

    def rows(parts: DataFrame, at: DataFrame) -> DataFrame:
        lines = parts.join(at, KEY).selectExpr(*KEY, "block", "posexplode(lines) AS (i, line)", "first")
        return lines.select(*KEY, "block", (F.col("first") + F.col("i")).alias("n"), "line").filter(f"n div {RANGE} = block AND line <> ''")

    b, a = own(before, "before_ord"), own(after, "after_ord")
    both = ranges(b).withColumnsRenamed({"x": "bx", "y": "by"}).join(ranges(a), [*KEY, "block"], "full_outer")
    at = both.filter(~(F.col("x").eqNullSafe(F.col("bx")) & F.col("y").eqNullSafe(F.col("by")))).groupBy(*KEY).agg(F.min("block").alias("block"))
    lines = rows(b, at).withColumnRenamed("line", "was").join(rows(a, at), [*KEY, "block", "n"], "full_outer")
    return lines.filter(~F.col("line").eqNullSafe(F.col("was"))).groupBy(*KEY).agg(F.min("n").alias("first_line"))


def explain_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file: status (same, changed, missing, added), reason, and first_line, the first line that differs.

    Reasons of a change, the first that holds: outer_blanks (blanks and TABs at the ends of lines), blank_lines (lines
    without text that came or went), blanks (both), content. A file that is the same may have line_ends of another kind.
    Empty lines at the end of a file do not count. Arguments are those of ``roundtrip_diff``.
    """
    b, a = _parts(before, "text"), _parts(after, "content")
    files = _fingerprints(b).withColumnRenamed("f", "b").join(_fingerprints(a).withColumnRenamed("f", "a"), KEY, "full_outer")
    alike = lambda name: F.col(f"a.{name}") == F.col(f"b.{name}")
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "added").when(alike("exact"), "same").otherwise("changed")

    def why(s: Column) -> Column:
        changed = F.when(alike("trimmed"), "outer_blanks").when(alike("full"), "blank_lines").when(alike("bare"), "blanks").otherwise("content")
        return F.when((s == "same") & ~alike("raw"), "line_ends").when(s == "changed", changed)

    judged = files.withColumn("status", status).withColumn("reason", let(F.col("status"), why))
    changed = judged.filter("status = 'changed'").select(*KEY, F.col("b.ord").alias("before_ord"), F.col("a.ord").alias("after_ord"))
    return judged.join(_first_lines(b, a, changed), KEY, "left").select(*KEY, "status", "reason", "first_line")
