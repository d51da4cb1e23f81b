"""Drop paths by ordered ignore rules; say which rule decided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.globs import Rule, is_excluded, rule_regex_column
from sheaf.functions.paths import components
from sheaf.functions.text import forward_slashes


# Globs of one tree, and the levels below its root.
LEVELS = 9
GLOBS_PER_TREE = 1 << LEVELS


def exclude_filter(files: DataFrame, rules: Sequence[Rule], path: str = "path") -> DataFrame:
    """Keep files no rule list excludes. Rows whose ``direct`` flag is set always stay."""
    kept = ~is_excluded(F.col(path), rules)
    if "direct" in files.columns:
        kept = F.col("direct") | kept
    return files.filter(kept)


# How a rule can be looked up: by a whole component, by what follows a component's last dot, or only by running
# its regex, then if possible on paths of its first folder alone.
def _rule_kind(pattern: Column, anchored: Column) -> Column:
    bare = ~anchored & ~pattern.contains("/") & (pattern != "")
    return (
        F.when(bare & ~pattern.rlike(r"[*?]"), "name")
        .when(bare & pattern.rlike(r"^\*\.[^*?.]+\z"), "extension")
        .otherwise("glob")
    )


def _first_folder(pattern: Column, anchored: Column, directory_only: Column) -> Column:
    """The first folder every path has that a glob can hit; '' if any may do."""
    rooted = F.regexp_replace(pattern, "^/", "")
    first = F.substring_index(rooted, "/", 1)
    # A pattern with a slash is read from the root, and one for folders literally.
    fixed = (anchored | F.contains(pattern, F.lit("/"))) & ((directory_only & ~rooted.startswith("/")) | ~first.rlike(r"[*?]"))
    return F.when(fixed, first).otherwise("")


def _trees(globs: DataFrame, keys: list[str]) -> DataFrame:
    """Globs (keys, rule, regex) as search trees over the order of rules.

    A tree is an array, the children of node ``i`` at ``2i + 1`` and ``2i + 2``. A node holds the alternation of the
    regexes below it, so a path that hits a node hits one of its rules; later rules are to the right.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rule")) - 1
    sets = globs.withColumn("tree", F.floor(place / GLOBS_PER_TREE)).groupBy(*keys, "tree").agg(F.array_sort(F.collect_list(F.struct("rule", "regex"))).alias("leaves"))
    levels = F.ceil(F.log2(F.size("leaves").cast("double"))).cast("int")

    nodes = F.expr("""flatten(transform(sequence(0, levels), k -> transform(sequence(0, shiftleft(1, k) - 1),
        i -> nullif(array_join(slice(leaves.regex, i * shiftleft(1, levels - k) + 1, shiftleft(1, levels - k)), '|'), ''))))""")
    return sets.withColumn("levels", levels).select(*keys, nodes.alias("nodes"), F.col("leaves.rule").alias("rules"))


# The last rule of a tree that hits a path: from the root to the right wherever that side hits, else to the left. Most paths
# hit nothing; the root is an expression of its own, whose regex stays compiled from row to row.
LAST_IN_TREE = f"""CASE WHEN regexp_instr(norm, get(nodes, 0)) > 0 THEN get(rules, reduce(sequence(1, {LEVELS}), 0,
    (at, level) -> CASE WHEN 2 * at + 2 >= size(nodes) THEN at WHEN regexp_instr(norm, get(nodes, 2 * at + 2)) > 0 THEN 2 * at + 2 ELSE 2 * at + 1 END)
  - shiftright(size(nodes), 1)) END"""

# What a path is looked up by.
LOOKUPS = """array_compact(concat(
  array_distinct(array(named_struct('kind', 'glob', 'key', ''), named_struct('kind', 'glob', 'key', substring_index(norm, '/', 1)))),
  flatten(transform(array_distinct(pieces), p -> array(named_struct('kind', 'name', 'key', p),
    CASE WHEN contains(p, '.') THEN named_struct('kind', 'extension', 'key', concat('.', substring_index(p, '.', -1))) END)))))"""


def rule_hits(
    paths: DataFrame, rules: DataFrame, ruleset: str = "ruleset_id", path: str = "path"
) -> DataFrame:
    """Deciding rule per (ruleset, path): columns ruleset, path, rule_ord, negated.

    ``paths`` holds a ruleset name per path. Most rules name a component or an extension, so they
    are found by equi-joins on the pieces of the path. What is left are true globs: they travel in search trees, one
    or more for each first folder that globs of a ruleset share, and a path meets the trees of its own folder and those
    without one. All of that is a single equi-join, so no pair of path and rule is built that does not share a key, and
    paths are read once. Spark picks the join from the sizes it measures. Only (ruleset, path) is shuffled, never
    content, and a rule is one number: its place and its sign, so that the last one is a plain maximum, taken before
    the shuffle as well.
    """
    r = rules.select(
        F.col("ruleset_id").alias(ruleset),
        "pattern",
        (F.col("rule_ord").cast("bigint") * 2 + F.col("negated").cast("int")).alias("rule"),
        _rule_kind(F.col("pattern"), F.col("anchored")).alias("kind"),
        _first_folder(F.col("pattern"), F.col("anchored"), F.col("directory_only")).alias("folder"),
        rule_regex_column(F.col("pattern"), F.col("directory_only"), F.col("anchored")).alias("regex"),
    )
    # The last rule of a kind and key is the only one that can decide, so one row per key is joined.
    keyed = (
        r.filter(F.col("kind") != "glob")
        .groupBy(ruleset, "kind", F.regexp_replace("pattern", r"^\*\.", ".").alias("key"))
        .agg(F.max("rule").alias("rule"))
    )
    globs = r.filter((F.col("kind") == "glob") & F.col("regex").isNotNull()).withColumn("key", F.col("folder"))
    trees = _trees(globs.select(ruleset, "kind", "key", "rule", "regex"), [ruleset, "kind", "key"])
    known = keyed.unionByName(trees, allowMissingColumns=True)

    # Neighbouring paths of one ruleset and folder try the same regexes, which then stay compiled.
    names = paths.select(ruleset, path).withColumn("norm", forward_slashes(F.col(path))).sortWithinPartitions(ruleset, "norm")
    pieces = names.select(ruleset, path, "norm", components(F.col("norm")).alias("pieces"))
    met = pieces.select(ruleset, path, "norm", F.expr(f"explode({LOOKUPS})").alias("lookup"))
    met = met.select(ruleset, path, "norm", "lookup.kind", "lookup.key").join(known, [ruleset, "kind", "key"])
    # One expression for trees of any folder and one for those of the path's own: each keeps the regex it has compiled.
    found = F.expr(f"CASE WHEN kind <> 'glob' THEN rule WHEN key = '' THEN {LAST_IN_TREE} ELSE {LAST_IN_TREE} END")
    return (
        met.select(ruleset, path, found.alias("rule"))
        .groupBy(ruleset, path)
        .agg(F.max("rule").alias("rule"))
        .filter("rule IS NOT NULL")
        .select(
            ruleset,
            path,
            F.floor(F.col("rule") / 2).cast("int").alias("rule_ord"),
            (F.col("rule") % 2 == 1).alias("negated"),
        )
    )


def exclude_join(
    files: DataFrame, rules: DataFrame, ruleset: str = "ruleset_id", path: str = "path"
) -> DataFrame:
    """:func:`exclude_filter` with rulesets kept in a table, one ruleset name per file."""
    chosen = files.filter(~F.col("direct")) if "direct" in files.columns else files
    hits = rule_hits(chosen, rules, ruleset, path).filter(~F.col("negated")).select(ruleset, path)
    if "direct" in files.columns:
        hits = hits.withColumn("direct", F.lit(False))
    return files.join(hits, hits.columns, "left_anti")


def exclusion_audit(
    paths: DataFrame, rules: DataFrame, ruleset: str = "ruleset_id", path: str = "path"
) -> DataFrame:
    """Paths decided by each rule that decided any."""
    decided = (
        rule_hits(paths, rules, ruleset, path)
        .groupBy(ruleset, "rule_ord")
        .agg(F.count("*").alias("paths"))
    )
    named = rules.select(F.col("ruleset_id").alias(ruleset), "rule_ord", "pattern", "negated")
    return named.join(decided, [ruleset, "rule_ord"])


def list_patterns(rules: DataFrame) -> DataFrame:
    return rules.select("ruleset_id", "rule_ord", "pattern").orderBy("ruleset_id", "rule_ord")
