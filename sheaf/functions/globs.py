"""Ignore rules: parsing, glob to regex, and the verdict on a path.

The same translation exists twice: as plain Python for a rule list known when the plan is built,
and as column expressions for rule tables. Tests hold the two against each other.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.binding import let
from sheaf.functions.text import SPACE_CLASS, trim_space


class Rule(NamedTuple):
    pattern: str
    negated: bool = False
    directory_only: bool = False
    anchored: bool = False


# The built-in rules, in their order.
DEFAULT_PATTERNS = """
.* node_modules target Thumbs.db __pycache__ dist build vendor
package-lock.json yarn.lock Cargo.lock
*.exe *.dll *.so *.dylib *.bin
*.pdf *.zip *.docx *.tar *.gz *.7z *.rar
*.png *.jpg *.jpeg *.gif *.ico *.svg *.webp *.bmp *.tiff
*.ttf *.otf *.woff *.woff2 *.eot
*.mp3 *.mp4 *.avi *.mov *.wav *.flac *.aac *.ogg
*.o *.obj *.lib *.a *.pyc *.tmp *.bak *.swp *.swo
""".split()


# ---- rule lists known on the driver ---------------------------------------------------------


def _flags(body: str, original: str) -> tuple[str, bool, bool]:
    directory_only = body.endswith("/")
    anchored = original.startswith("/") and not original.startswith("//")
    return body.removesuffix("/"), directory_only, anchored


def _unescape(pattern: str) -> str:
    return re.sub(r"\\(.)", r"\1", pattern, flags=re.S)


def default_rules() -> list[Rule]:
    return [Rule(p) for p in DEFAULT_PATTERNS]


def parse_rules(text: str) -> list[Rule]:
    """Rules of a rule file: one per line, ``#`` comments and blank lines left out."""
    rules = []
    for line in re.split(r"\r?\n", text):
        line = re.sub(rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\Z", "", line)
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        line = line[negated:]
        body, directory_only, anchored = _flags(line, line.removesuffix("/"))
        rules.append(Rule(_unescape(body), negated, directory_only, anchored))
    return rules


def literal_rules(patterns: Iterable[str]) -> list[Rule]:
    """Rules given as a settings list: the text is the pattern, a final slash included."""
    return [Rule(p, directory_only=p.endswith("/")) for p in patterns]


def added_rule(pattern: str) -> Rule:
    """A rule added by a caller: like a file line, but never trimmed and never a comment."""
    negated = pattern.startswith("!")
    body, directory_only, anchored = _flags(pattern[negated:], pattern)
    return Rule(_unescape(body), negated, directory_only, anchored)


_SPECIAL = re.compile(r"[.^$|()\[\]{}+*?\\]")
_TOKEN = re.compile(r"\*\*\Z|\*\*/|\*|\?|[^*?]+", re.S)


def quote(text: str) -> str:
    """Quote for Java, RE2 and Python alike."""
    return _SPECIAL.sub(lambda m: "\\" + m.group(), text)


def glob_regex(pattern: str, in_component: bool = False) -> str:
    """The unanchored regex of a glob. ``in_component`` keeps a final ``**`` within one name."""
    wild = {"**": "[^/]*" if in_component else ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}
    return "".join(wild.get(tok) or quote(tok) for tok in _TOKEN.findall(pattern))


def _component_regex(rule: Rule) -> str | None:
    """The regex one path component has to match, for rules that look at names only."""
    if not rule.pattern or rule.anchored or "/" in rule.pattern:
        return None
    if rule.pattern.endswith("**") and not rule.directory_only:
        return None
    return glob_regex(rule.pattern, in_component=True)


def rule_regex(rule: Rule) -> str | None:
    """The regex (to be searched) that decides whether a rule hits a path; None never hits."""
    if not rule.pattern:
        return None
    name = _component_regex(rule)
    if name is not None:
        return f"(?s)(?:^|/)(?:{name})(?:/|\\z)"
    if rule.anchored or "/" in rule.pattern:
        rooted = rule.pattern.removeprefix("/")
        if rule.directory_only:
            return f"(?s)^{quote(rooted)}(?:/|\\z)"
        return f"(?s)^{glob_regex(rooted)}\\z"
    whole, name = glob_regex(rule.pattern), glob_regex(rule.pattern, in_component=True)
    return f"(?s)^{whole}\\z|(?:^|/){name}(?:/|\\z)"


_ANY_NAME = "[^/]*"


def _run_regex(rules: Sequence[Rule]) -> str | None:
    """One regex for neighbouring rules of one sign: name rules share a few alternations.

    A name rule that starts with a star may start anywhere in a component, so its star is dropped;
    extensions share their dot. A path is then gone through once, not once per rule.
    """
    names = [n for r in rules if (n := _component_regex(r)) is not None]
    rest = [x for r in rules if _component_regex(r) is None and (x := rule_regex(r))]
    exact = [n for n in names if not n.startswith(_ANY_NAME)]
    tails = [n.removeprefix(_ANY_NAME) for n in names if n.startswith(_ANY_NAME)]
    dotted = [t.removeprefix("\\.") for t in tails if t.startswith("\\.")]
    other = [t for t in tails if not t.startswith("\\.")]
    parts = []
    for lead, group in (("(?:^|/)", exact), ("\\.", dotted), ("", other)):
        if group:
            parts.append(f"{lead}(?:{'|'.join(group)})(?:/|\\z)")
    parts += [x.removeprefix("(?s)") for x in rest]
    return "(?s)" + "|".join(parts) if parts else None


def is_excluded(path: Column, rules: Sequence[Rule]) -> Column:
    """Ordered verdict: the last rule that hits the path decides, no hit keeps it.

    Built as one CASE from the last rule to the first, so evaluation stops at the first hit.
    """
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    runs = [(neg, list(run)) for neg, run in itertools.groupby(rules, key=lambda r: r.negated)]
    case = None
    for negated, run in reversed(runs):
        regex = _run_regex(run)
        if regex is not None:
            hit = path.rlike(regex)
            case = F.when(hit, not negated) if case is None else case.when(hit, not negated)
    return F.lit(False) if case is None else case.otherwise(False)


def _covers(rule: Rule) -> list[str]:
    """Regexes over a folder with a slash behind it; one that is found says that the rule hits every path below."""
    if not rule.pattern:
        return []
    found = []
    rooted = rule.pattern.removeprefix("/")
    by_path = rule.anchored or "/" in rule.pattern
    if not by_path:
        found.append(f"(?s)(?:^|/)(?:{glob_regex(rule.pattern, in_component=True)})/")
    elif rule.directory_only:
        found.append(f"(?s)^{quote(rooted)}/")
    if rooted.endswith("**") and not rule.directory_only:
        found.append(f"(?s)^{glob_regex(rooted)}\\z")
    return found


def _touches(rule: Rule) -> str | None:
    """The regex over a folder with a slash behind it that is found if the rule may hit a path below; None never does.

    What is left of a glob below a folder is told by its leading components: each has to match that of the folder, and
    a glob without ``**`` needs one more than the folder has.
    """
    if not rule.pattern:
        return None
    if not rule.anchored and "/" not in rule.pattern:
        return ""
    rooted = rule.pattern.removeprefix("/")
    parts = rooted.split("/")
    if rule.directory_only:
        lead, rest = [quote(x) for x in parts], ".*"
    else:
        free = next((i for i, x in enumerate(parts) if "**" in x), None)
        lead = [glob_regex(x) for x in (parts[:-1] if free is None else parts[:free])]
        rest = "" if free is None else ".*"
    nested = rest
    for part in reversed(lead):
        nested = f"(?:{part}/{nested})?"
    return f"(?s)^{nested}\\z"


def is_closed(folder: Column, rules: Sequence[Rule]) -> Column:
    """True where rules exclude every path below a folder, so that it need not be opened.

    From the last rule to the first: one that takes paths back and may hit one below leaves the folder open, one that
    excludes all below closes it.
    """
    path = F.concat(F.replace(folder, F.lit("\\"), F.lit("/")), F.lit("/"))
    case = None
    for rule in reversed(rules):
        regexes = [x for x in [_touches(rule)] if x is not None] if rule.negated else _covers(rule)
        for regex in regexes:
            hit = path.rlike(regex)
            case = F.when(hit, not rule.negated) if case is None else case.when(hit, not rule.negated)
    return F.lit(False) if case is None else case.otherwise(False)


# ---- rule tables ----------------------------------------------------------------------------


def _parsed(body: Column, original: Column, negated: Column) -> Column:
    directory_only = body.endswith("/")
    cut = F.when(directory_only, F.regexp_replace(body, r"/\z", "")).otherwise(body)
    anchored = original.startswith("/") & ~original.startswith("//")
    return F.struct(
        F.regexp_replace(cut, r"(?s)\\(.)", "$1").alias("pattern"),
        negated.alias("negated"),
        directory_only.alias("directory_only"),
        anchored.alias("anchored"),
    )


def _without_bang(line: Column) -> Column:
    return F.regexp_replace(line, "^!", "")


def parse_rule_line(line: Column) -> Column:
    """Struct of a rule-file line; null for blanks and comments."""

    def parse(line: Column) -> Column:
        rule = let(
            _without_bang(line),
            lambda body: _parsed(body, F.regexp_replace(body, r"/\z", ""), line.startswith("!")),
        )
        return F.when((line != "") & ~line.startswith("#"), rule)

    return let(trim_space(line), parse)


def parse_literal_rule(pattern: Column) -> Column:
    return F.struct(
        pattern.alias("pattern"),
        F.lit(False).alias("negated"),
        pattern.endswith("/").alias("directory_only"),
        F.lit(False).alias("anchored"),
    )


def parse_added_rule(pattern: Column) -> Column:
    return let(
        pattern,
        lambda given: let(
            _without_bang(given), lambda body: _parsed(body, given, given.startswith("!"))
        ),
    )


# Private marks that stand for wildcards while the rest is put together; noncharacters, so no path
# or pattern in valid text carries them.
_TAIL, _DIRS, _STAR, _ONE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def glob_regex_column(pattern: Column, in_component: bool = False) -> Column:
    out = F.regexp_replace(pattern, r"\*\*\z", _TAIL)
    out = F.regexp_replace(out, r"\*\*/", _DIRS)
    out = F.translate(out, "*?", _STAR + _ONE)
    out = quote_column(out)
    for mark, regex in (
        (_TAIL, "[^/]*" if in_component else ".*"),
        (_DIRS, "(?:.*/)?"),
        (_STAR, "[^/]*"),
        (_ONE, "[^/]"),
    ):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return out


def quote_column(text: Column) -> Column:
    return F.regexp_replace(text, r"([.^$|()\[\]{}+*?\\])", r"\\$1")


def rule_regex_column(pattern: Column, directory_only: Column, anchored: Column) -> Column:
    """:func:`rule_regex` over the columns of a rule table."""

    def compiled(rule: Column) -> Column:
        given, only_dirs = rule["pattern"], rule["directory_only"]
        rooted = F.regexp_replace(given, "^/", "")
        name = F.concat(F.lit("(?:^|/)"), glob_regex_column(given, True), F.lit("(?:/|\\z)"))
        whole = F.concat(F.lit("^"), glob_regex_column(given), F.lit("\\z|"))
        by_path = rule["anchored"] | F.contains(given, F.lit("/"))
        regex = (
            F.when(by_path & only_dirs, F.concat(F.lit("^"), quote_column(rooted), F.lit("(?:/|\\z)")))
            .when(by_path, F.concat(F.lit("^"), glob_regex_column(rooted), F.lit("\\z")))
            .when(only_dirs, name)
            .otherwise(F.concat(whole, name))
        )
        return F.when(given != "", F.concat(F.lit("(?s)"), regex))

    rule = F.struct(
        pattern.alias("pattern"),
        directory_only.alias("directory_only"),
        anchored.alias("anchored"),
    )
    return let(rule, compiled)
