"""Boolean trigram queries of regular expressions.

A query is a set of clauses, each a set of trigrams in lower case: a text can match only if it holds all
trigrams of some clause. The query of a rule without mandatory trigrams is the one empty clause.
"""

from __future__ import annotations

import re._parser as syntax
from re._constants import ANY, ASSERT, ASSERT_NOT, AT, BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, NOT_LITERAL, RANGE, SUBPATTERN

Clauses = frozenset[frozenset[str]]

EVERY: Clauses = frozenset({frozenset()})
STRINGS, MEMBERS, CLAUSES = 128, 8, 24


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _fewest(clauses) -> Clauses:
    """Without clauses that another one implies; a query of too many clauses asks for nothing."""
    kept: list[frozenset[str]] = []
    for clause in sorted(set(clauses), key=len):
        if not any(k <= clause for k in kept):
            kept.append(clause)
    return frozenset(kept) if len(kept) <= CLAUSES else EVERY


def _both(x: Clauses, y: Clauses) -> Clauses:
    both = _fewest(a | b for a in x for b in y)
    return both if both != EVERY else (x if y == EVERY else y)


def _of_strings(strings: frozenset[str]) -> Clauses:
    return _fewest(trigrams(s) for s in strings)


def _members(items) -> frozenset[str] | None:
    """The characters of a class if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is LITERAL:
            out.add(chr(value).lower())
        elif op is RANGE and value[1] - value[0] < MEMBERS:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= MEMBERS else None


def _walk(items) -> tuple[frozenset[str] | None, Clauses]:
    """All strings that match, if they are few, and the query otherwise."""
    strings: frozenset[str] = frozenset({""})
    query, exact = EVERY, True
    for op, value in items:
        own, more = _one(op, value)
        if own is not None and len(own) * len(strings) <= STRINGS:
            strings = frozenset(s + t for s in strings for t in own)
            continue
        exact = False
        query = _both(_both(query, _of_strings(strings)), more if own is None else _of_strings(own))
        strings = frozenset({""})
    if exact:
        return strings, EVERY
    return None, _both(query, _of_strings(strings))


def _one(op, value) -> tuple[frozenset[str] | None, Clauses]:
    if op is LITERAL:
        return frozenset({chr(value).lower()}), EVERY
    if op is IN:
        return _members(value), EVERY
    if op is SUBPATTERN:
        return _walk(value[3])
    if op is BRANCH:
        parts = [_walk(p) for p in value[1]]
        if all(p[0] is not None for p in parts):
            union = frozenset().union(*(p[0] for p in parts))
            if len(union) <= STRINGS:
                return union, EVERY
        return None, _fewest(c for s, q in parts for c in (q if s is None else _of_strings(s)))
    if op in (MAX_REPEAT, MIN_REPEAT):
        least, most, body = value
        strings, query = _walk(body)
        if least == 0:
            return (strings | {""} if most == 1 and strings is not None else None), EVERY
        if strings is not None:
            if least == most == 1:
                return strings, EVERY
            return None, _of_strings(strings)
        return None, query
    if op in (AT, ASSERT, ASSERT_NOT):
        return frozenset({""}), EVERY
    if op in (ANY, NOT_LITERAL):
        return None, EVERY
    raise ValueError(f"no trigram query for {op}")


def query(pattern: str) -> Clauses:
    strings, clauses = _walk(syntax.parse(pattern))
    return clauses if strings is None else _of_strings(strings)
