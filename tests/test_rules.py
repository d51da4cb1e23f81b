"""Ignore rules: pinned cases, random pairs against a small matcher, lists against tables."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions.globs import (
    Rule,
    added_rule,
    default_rules,
    is_closed,
    is_excluded,
    literal_rules,
    parse_rules,
    rule_regex,
    rule_regex_column,
)
from sheaf.operators.exclude import exclude_filter, exclude_join, exclusion_audit, list_patterns, rule_hits
from sheaf.sources.rules import default_rules_table, parse_rule_lines, resolve_ruleset, rules_table, scan_rules

# Per way of matching: (defaults first?, rule lines, excluded, kept).
CASES = [
    # The built-in rules: dot names, folders, lock files, suffixes.
    (True, "", [".venv/lib/x.py", "deep/__pycache__/m.pyc", "Cargo.lock", "w/dist", "song.flac"], ["lib/x.py", "Cargo.toml", "distance/x"]),
    # A bare name: any component, or the whole path.
    (False, "notes", ["notes", "home/notes", "notes/2024/may.md"], ["notes.md", "mynotes/x"]),
    (False, "*.csv", ["rows.csv", "in/2020.csv", "old.csv/part"], ["rows.csv.gz", "csv"]),
    (False, "v?", ["v1", "pkg/v2/x"], ["v", "v10"]),
    (False, "**", ["p", "p/q/r"], []),
    # A bare folder rule.
    (False, "cache/", ["cache", "cache/1/2", "srv/cache/k"], ["cache.db", "recache/x"]),
    # Anchored, and with a slash inside: the whole path.
    (False, "/etc", ["etc"], ["usr/etc", "etcd"]),
    (False, "pics/*.raw", ["pics/7.raw"], ["pics/a/7.raw", "my/pics/7.raw"]),
    (False, "**/draft", ["draft", "ch1/draft", "ch1/s2/draft"], ["ch1/draft2", "draft/x"]),
    (False, "doc/**", ["doc/i", "doc/en/i"], ["doc", "my/doc/i"]),
    (False, "lib/**/gen", ["lib/gen", "lib/m/gen", "lib/m/n/gen"], ["lib/regen", "lib/gen/x"]),
    (False, "p/**/q/**/r", ["p/q/r", "p/1/q/2/3/r"], ["p/1/2/r", "0/p/q/r"]),
    # A folder rule with a slash inside is literal.
    (False, "pkg/?/", ["pkg/?", "pkg/?/m"], ["pkg/a/m", "pkg"]),
    # Order: the last rule that hits decides.
    (True, "*.dat\n!gold.dat", ["b.dat", "s/b.dat"], ["gold.dat", "s/gold.dat"]),
    (False, "!k\nk", ["k"], ["kk"]),
    (False, "k\n!k\n!k\nk", ["k"], []),
    (False, "tmp/\n!tmp/keep", ["tmp/x"], ["tmp/keep"]),
    # Backslashes: dropped in rules, separators in paths.
    (False, "\\?.md", ["z.md"], ["zz.md"]),
    (False, "fi\\le", ["file"], ["fi\\le/x"]),
    (False, "leaf", ["dir\\leaf", "leaf"], ["dir\\leaves"]),
]


def verdicts(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r["path"]: r["x"] for r in df.select("path", is_excluded(F.col("path"), rules).alias("x")).collect()}


@pytest.mark.parametrize("defaults,lines,excluded,kept", CASES)
def test_pinned_cases(spark, defaults, lines, excluded, kept):
    rules = (default_rules() if defaults else []) + parse_rules(lines)
    want = {p: True for p in excluded} | {p: False for p in kept}
    assert verdicts(spark, rules, want) == want


def test_added_and_literal_forms(spark):
    # An added rule is neither a comment nor trimmed.
    rules = [added_rule("#todo"), added_rule(" lead"), added_rule("fin*"), added_rule("!fin\\?")]
    want = {"#todo": True, "x/#todo": True, " lead": True, "lead": False, "final": True, "fine": False}
    assert verdicts(spark, rules, want) == want
    # A settings list keeps the final slash, so a folder rule in it hits nothing below the folder.
    assert literal_rules(["env/"]) == [Rule("env/", directory_only=True)]
    assert verdicts(spark, literal_rules(["env/"]), ["env", "env/bin"]) == {"env": False, "env/bin": False}


def test_direct_files_are_not_excluded(spark):
    df = spark.createDataFrame([("a.log", True), ("b.log", False)], "path string, direct boolean")
    assert [r.path for r in exclude_filter(df, [Rule("*.log")]).collect()] == ["a.log"]


def reach(pattern, path):
    """Does the glob match? Walks the set of pattern places reachable after every character."""
    tokens, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        token = "**" if rest == "**" else "**/" if rest.startswith("**/") else rest[0]
        tokens.append(token)
        i += len(token)
    n = len(tokens)

    def close(places):
        todo = list(places)
        while todo:
            p = todo.pop()
            inner, k = p
            if k < n and tokens[k] in ("*", "**", "**/") and not inner and (False, k + 1) not in places:
                places.add((False, k + 1))
                todo.append((False, k + 1))
        return places

    places = close({(False, 0)})
    for c in path:
        after = set()
        for inner, k in places:
            if k == n:
                continue
            t = tokens[k]
            if t == "**":
                after.add((False, k))
            elif t == "**/":
                # Within a skipped stretch of folders; only a slash may end it.
                after.add((True, k))
                if c == "/":
                    after.add((False, k + 1))
            elif t in ("*", "?"):
                if c != "/":
                    after.add((False, k if t == "*" else k + 1))
            elif t == c:
                after.add((False, k + 1))
        places = close(after)
    return (False, n) in places


def hits(rule, path):
    if not rule.pattern:
        return False
    if rule.anchored or "/" in rule.pattern:
        p = rule.pattern.removeprefix("/")
        return (path == p or path.startswith(p + "/")) if rule.directory_only else reach(p, path)
    by_name = any(reach(rule.pattern, c) for c in path.split("/"))
    return by_name or (not rule.directory_only and reach(rule.pattern, path))


def random_pairs(n, seed=7):
    rnd = random.Random(seed)
    for _ in range(n):
        pattern = "".join(rnd.choice("ab*?*/.*[+") for _ in range(rnd.randint(0, 7)))
        path = "".join(rnd.choice("aabb/.[+") for _ in range(rnd.randint(1, 8)))
        yield Rule(pattern, False, rnd.random() < 0.3, rnd.random() < 0.2), path


def test_random_globs_against_matcher(spark):
    pairs = list(random_pairs(20_000))
    rows = [(i, r.pattern, r.directory_only, r.anchored, rule_regex(r), p) for i, (r, p) in enumerate(pairs)]
    df = spark.createDataFrame(
        rows, "i int, pattern string, directory_only boolean, anchored boolean, regex string, path string"
    )
    column = rule_regex_column(F.col("pattern"), F.col("directory_only"), F.col("anchored"))
    got = df.select(
        "i",
        F.coalesce(F.rlike("path", "regex"), F.lit(False)).alias("by_list"),
        F.coalesce(F.rlike("path", column), F.lit(False)).alias("by_table"),
    ).collect()
    found = 0
    for row in got:
        want = hits(*pairs[row.i])
        found += want
        assert (row.by_list, row.by_table) == (want, want), pairs[row.i]
    assert found > 1000


def test_last_hit_decides_lists_and_tables_agree(spark):
    rnd = random.Random(3)
    names = ["a", "b", "a.log", "b.log", "lib.d", "x.tar.gz", "c"]
    globs = names + ["*.log", "*.gz", "*.d", "a/", "?.log", "**/b", "a/**", "/a", "lib.*", "*.tar.gz", "a/*/c"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(300)})
    for trial in range(4):
        rules = parse_rules("\n".join(rnd.choice(["", "", "!"]) + rnd.choice(globs) for _ in range(9)))
        want = {}
        for p in paths:
            decided = [r for r in rules if hits(r, p)]
            want[p] = bool(decided) and not decided[-1].negated
        assert verdicts(spark, rules, paths) == want
        files = spark.createDataFrame([("s", p) for p in paths], "ruleset_id string, path string")
        kept = exclude_join(files, rules_table(spark, "s", rules)).collect()
        assert {r.path for r in kept} == {p for p in paths if not want[p]}


def test_closed_folders_hold_nothing_that_stays(spark):
    """Every path over a small alphabet, random rules: a closed folder has no path below that is kept."""
    rnd = random.Random(8)
    names = ["a", "b", "a.b", "ab"]
    level = [(x,) for x in names]
    paths = list(level)
    for _ in range(3):
        level = [(*p, x) for p in level for x in names]
        paths += level
    paths = ["/".join(p) for p in paths]
    folders = [p for p in paths if p.count("/") < 3]
    parts = [*names, "*", "?", "**", "a*", "*b", "a**", "?.b", "**b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    closed_count = 0
    for _ in range(25):
        rules = []
        for _ in range(rnd.randrange(1, 5)):
            glob = "/".join(rnd.choices(parts, k=rnd.choice([1, 1, 2, 3])))
            rules += parse_rules(rnd.choice(["", "", "!"]) + rnd.choice(["", "/"]) + glob + rnd.choice(["", "/"]))
        rows = df.select("path", is_excluded(F.col("path"), rules).alias("gone"), is_closed(F.col("path"), rules).alias("closed")).collect()
        kept = [r.path for r in rows if not r.gone]
        for r in rows:
            if r.closed and r.path in folders:
                assert not [p for p in kept if p.startswith(r.path + "/")], (rules, r.path)
        closed = {r.path for r in rows if r.closed}
        closed_count += len(closed)
        if not any(x.negated for x in rules):  # without exceptions a folder that a plain name excludes is closed
            assert {p for p in folders for x in rules if x.pattern == p.split("/")[-1] and not x.anchored} <= closed
    assert closed_count > 200


def test_exceptions_keep_folders_open(spark):
    cases = [
        ("build", "build", True), ("build", "x/build/y", True), ("build\n!keep", "build", False), ("build\n!/src/*.md", "build", True),
        ("build\n!/build/*.md", "build", False), ("build\n!/build/*.md", "build/x", True), ("build\n!**/x", "build", False), ("a/**", "a", True),
        ("a/*", "a", False), ("/a/b/", "a/b/c", True), ("/a/b/", "a", False), ("!x\nbuild", "build", True), ("build\n!/build/x/", "build/x/y", False),
        ("build\n!/build/x/", "build/z", True), ("*.d", "lib.d", True), ("*.d\n!/?ib.d/a/*", "lib.d", False), ("*.d\n!/?ib.d/a/*", "lib.d/b", True),
    ]
    got = spark.range(1).select(*[is_closed(F.lit(path), parse_rules(rules)) for rules, path, _ in cases]).first()
    assert list(got) == [want for _, _, want in cases]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1300])
def test_trees_of_globs(spark, n):
    """Sets of globs of any size, more than a tree holds among them: the last that hits decides."""
    rnd = random.Random(n)
    names = ["a", "b", "c", "d", "e.x", "f.y"]
    parts = [*names, "*", "?", "**", "*.x", "[e]*", "e?x", "a*"]
    lines = ["/".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n)]
    rules = parse_rules("\n".join(rnd.choice(["", "!"]) + rnd.choice(["", "", "/"]) + x + rnd.choice(["", "", "/"]) for x in lines))
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(200)})
    files = spark.createDataFrame([("s", p) for p in paths], "ruleset_id string, path string")
    got = {r.path: (r.rule_ord, r.negated) for r in rule_hits(files, rules_table(spark, "s", rules)).collect()}
    want = {}
    for p in paths:
        decided = [(i, r.negated) for i, r in enumerate(rules) if hits(r, p)]
        if decided:
            want[p] = decided[-1]
    assert got == want


def test_lines_parse_alike_in_lists_and_tables(spark):
    lines = ["*.log", "  x/ ", "# c", "", "!", "!/a", "//b", "/", "/c/", "!d\\ e/", "\\#f", "a\\", " g\u3000",
             "!!h", "\\!i", "/\\/j", "!//k/"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "ruleset_id string, line_no int, line string")
    table = [Rule(*r[2:]) for r in parse_rule_lines(df).orderBy("rule_ord").collect()]
    assert table == parse_rules("\n".join(lines))
    added = [Rule(*r[2:]) for r in parse_rule_lines(df, "added").orderBy("rule_ord").collect()]
    assert added == [added_rule(x) for x in lines]
    literal = [Rule(*r[2:]) for r in parse_rule_lines(df, "literal").orderBy("rule_ord").collect()]
    assert literal == literal_rules(lines)


def test_rule_files_keep_their_order(spark, tmp_path):
    (tmp_path / "rules").write_text("*.log\r\n\n# c\n!keep.log\nbuild/\n")
    lines = scan_rules(spark, str(tmp_path / "rules"))
    rules = parse_rule_lines(lines).orderBy("rule_ord").collect()
    assert [(r.rule_ord, r.pattern, r.negated, r.directory_only) for r in rules] == [
        (0, "*.log", False, False), (3, "keep.log", True, False), (4, "build", False, True),
    ]
    assert list_patterns(parse_rule_lines(lines)).count() == 3


def test_audit_counts_the_deciding_rule(spark):
    files = spark.createDataFrame([("s", p) for p in ("a.log", "b.log", "k/keep.log", "c")], "ruleset_id string, path string")
    table = rules_table(spark, "s", parse_rules("*.log\n!keep.log"))
    got = {(r.pattern, r.negated): r.paths for r in exclusion_audit(files, table).collect()}
    assert got == {("*.log", False): 2, ("keep.log", True): 1}


def test_ruleset_precedence(spark):
    offers = [
        ("typed", "text", ["*.a"]), ("typed", "settings", ["s/"]),
        ("named", "named", ["*.n"]), ("named", "local", ["*.l"]), ("named", "settings", ["s/"]),
        ("missing", "named", None), ("missing", "local", ["*.l"]), ("missing", "settings", ["s/"]),
        ("local", "local", ["# only a comment"]), ("local", "settings", ["s/"]),
        ("bare", "settings", ["s/"]), ("blank", "text", ["", "  "]), ("blank", "settings", ["s/"]),
    ]
    df = spark.createDataFrame(offers, "ruleset_id string, origin string, lines array<string>")
    got = {}
    for r in resolve_ruleset(df).orderBy("ruleset_id", "rule_ord").collect():
        got.setdefault(r.ruleset_id, []).append(r.pattern)
    defaults = [r.pattern for r in default_rules()]
    assert len(defaults) == 54 == default_rules_table(spark).count()
    assert got == {
        "typed": ["*.a"], "named": defaults + ["*.n"], "missing": defaults + ["s/"],
        "local": defaults, "bare": defaults + ["s/"], "blank": defaults,
    }
