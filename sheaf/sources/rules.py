"""Rule tables: read rule files, parse lines, choose the ruleset of a bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.globs import (
    DEFAULT_PATTERNS,
    Rule,
    parse_added_rule,
    parse_literal_rule,
    parse_rule_line,
)
from sheaf.functions.text import split_lines, trim_space
from sheaf.schemas import RULES

_FORMS = {"file": parse_rule_line, "literal": parse_literal_rule, "added": parse_added_rule}


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """Lines of rule files, one ruleset per file (named by its path), in order."""
    whole = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("ruleset_id"), "value"
    )
    return whole.select("ruleset_id", F.posexplode(split_lines(F.col("value"))).alias("line_no", "line"))


def parse_rule_lines(lines: DataFrame, form: str = "file") -> DataFrame:
    """Rules of rule lines (ruleset_id, line_no, line); form is file, literal or added.

    ``literal`` keeps a final slash in the pattern, as settings lists do.
    """
    return (
        lines.withColumn("rule", _FORMS[form](F.col("line")))
        .filter("rule IS NOT NULL")
        .select("ruleset_id", F.col("line_no").cast("int").alias("rule_ord"), "rule.*")
    )


def rules_table(spark: SparkSession, ruleset_id: str, rules: Sequence[Rule]) -> DataFrame:
    rows = [(ruleset_id, i, *rule) for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def default_rules_table(spark: SparkSession, ruleset_id: str = "default") -> DataFrame:
    return rules_table(spark, ruleset_id, [Rule(p) for p in DEFAULT_PATTERNS])


def resolve_ruleset(offers: DataFrame) -> DataFrame:
    """The rules of every ruleset from what is on offer (ruleset_id, origin, lines).

    Origins: ``text`` (typed in; stands alone, or for the built-in rules if blank), ``named`` (a rule file asked for;
    lines are null if it is missing), ``local`` (a rule file found in place, looked at only if none
    was named), ``settings`` (the literal list used when no file counts). All but ``text`` come
    after the built-in rules. Several offers of one origin follow one another, by ``offer_ord`` if
    there is such a column, else by their lines.
    """
    place = F.col("offer_ord") if "offer_ord" in offers.columns else F.lit(0)

    def offer(origin: str):
        there = (F.col("origin") == origin) & F.col("lines").isNotNull()
        every = F.array_sort(F.collect_list(F.when(there, F.struct(place.alias("ord"), "lines"))))
        return F.when(F.size(every) > 0, F.flatten(F.transform(every, lambda x: x["lines"]))).alias(origin)

    per_set = offers.groupBy("ruleset_id").agg(
        *(offer(o) for o in ("text", "named", "local", "settings")),
        F.count_if(F.col("origin") == "named").alias("asked"),
    )
    local = F.when(F.col("asked") == 0, F.col("local"))
    typed_in = F.array_compact(F.transform("text", parse_rule_line))
    from_file = F.array_compact(F.transform(F.coalesce("named", local), parse_rule_line))
    from_list = F.transform(F.coalesce("settings", F.array().cast("array<string>")), parse_literal_rule)
    built_in = F.transform(F.array(*map(F.lit, DEFAULT_PATTERNS)), parse_literal_rule)
    nothing_typed = F.forall("text", lambda line: trim_space(line) == "")
    rules = (
        F.when(F.col("text").isNull(), F.concat(built_in, F.coalesce(from_file, from_list)))
        .when(nothing_typed, built_in)
        .otherwise(typed_in)
    )
    return (
        per_set.select("ruleset_id", F.posexplode(rules).alias("rule_ord", "rule"))
        .select("ruleset_id", "rule_ord", "rule.*")
    )
