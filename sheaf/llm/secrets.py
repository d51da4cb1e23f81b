"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From it a Boolean trigram query is derived (``trigrams``). The index
holds a posting (trigram, text) for every trigram that some rule asks for; texts are named by 128 bits of
their content, so copies share postings. Postings of a clause are intersected by an aggregate: a text is
a candidate of a rule if it has all trigrams of one of the rule's clauses. Candidates are joined back to
the documents and verified by the regular expression itself. Rules without mandatory trigrams (``hex``)
scan every text.

A rule takes its leftmost non-overlapping matches; those whose ``group`` has fewer than ``least``
characters are dropped after they have been matched. Offsets count code points, the end is exclusive.
Null texts count as empty and have no spans. Every row has its own result, so repeated rows and ties need
no rule; empty tables give empty ones. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.trigrams import EVERY, query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Runs of hexadecimal digits and access keys are maximal, so their lengths can stand in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats of public issuers, and credentials in addresses and headers.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    # No group stands under a star: such are matched by recursion, as deep as the text is long.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", True),
    Rule("login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]+@"),
)
RULES = BASE + MORE


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``trigram, t1, t2`` of all texts, for the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for clause in query(r.pattern) for t in clause})
    low = _text(docs).select("t1", "t2", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return low.select("t1", "t2", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``t1, t2, kinds``: the rules whose trigram query a text meets. Rules that scan fully are not in it."""
    rows = []
    for rule in rules:
        for n, clause in enumerate(sorted(query(rule.pattern), key=sorted)):
            rows += [(t, rule.kind, n, 1 << bit, (1 << len(clause)) - 1) for bit, t in enumerate(sorted(clause))]
    clauses = postings.sparkSession.createDataFrame(rows, "trigram string, kind string, clause int, bit bigint, full bigint")
    met = (
        postings.join(F.broadcast(clauses), "trigram")  # a few rows a rule
        .groupBy("t1", "t2", "kind", "clause")
        .agg((F.bit_or("bit") == F.max("full")).alias("met"))
        .filter("met")
    )
    return met.groupBy("t1", "t2").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of ``start, end`` of the matches that hold."""
    regex, none = F.lit(rule.regex), F.array().cast("array<struct<start:int,end:int>>")
    found = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.char_length(m))
    held = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda m: F.char_length(m) >= rule.least)
    gaps = F.transform(F.split(text, rule.regex, -1), lambda p: F.char_length(p))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("size"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
        # After the last gap no match follows: its size and verdict are null.
        return F.struct(
            (begin + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["held"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    return F.when(text.rlike(rule.regex), F.aggregate(steps, start, step)["out"]).otherwise(none)


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``: array of ``start, rank, kind, end``, sorted, of every row."""
    named = _text(docs)
    found = candidates(build_index(docs, rules), rules)
    rows = named.join(found.hint("shuffle_hash"), ["t1", "t2"], "left")
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        if query(rule.pattern) != EVERY:
            is_candidate = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            spans = F.when(is_candidate, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        parts.append(_ranked(spans, rank, rule.kind))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the base counts and digest, and all spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scan(docs).select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
