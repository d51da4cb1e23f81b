import hashlib
import random
import re

import pytest

from sheaf.llm import secrets, trigrams

PLAIN = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def plain(text):
    base = []
    for rank, (kind, regex, group, least) in enumerate(PLAIN):
        base += [(m.start(), rank, kind, m.end()) for m in regex.finditer(text or "") if len(m.group(group)) >= least]
    more = []
    for rank, rule in enumerate(secrets.MORE, 3):
        regex = re.compile(rule.pattern, re.A | (re.I if rule.any_case else 0))
        more += [(m.start(), rank, rule.kind, m.end()) for m in regex.finditer(text or "")]
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    n = [sum(k == kind for _, _, k, _ in base) for kind in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(join(base).encode()).hexdigest(), join(base + more))


def ours(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in secrets.secret_report(df).collect()), key=repr)


def made(seed, n=300):
    r = random.Random(seed)
    pieces = [
        "password", "PassWd", "secret", "toKen", "ſecret", "toKen", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "ab", "abcdef", "x" * 9, "+/_.=-", "é", "日本😀",
        "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7H8", "AKIA" + "Q" * 15, "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "abcdefabcdefabcdefabcdef", "abcdefabcdefabcdefabcde", "g", "\n",
        "ghp_" + "a" * 36, "xoxb-1234567890a", "AIza" + "-" * 35, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
        "Bearer ", "t" * 20, "http://user:pw@host", "://", "token=token:token:abcdefgh",
    ]
    return [(i, "".join(r.choice(pieces) for _ in range(r.randrange(14)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_search(spark, seed):
    rows = made(seed)
    rows += [(900, None), (901, ""), (None, rows[4][1]), rows[7], rows[7]]
    rows += [(902, "é" * 50_000 + " token = abcdefgh " + "f" * 40_000 + " pass AKIA" * 5_000), (903, "token=abcdef " * 3_000)]
    assert ours(spark, rows) == sorted(((d, *plain(t)) for d, t in rows), key=repr)


def test_long_repeats_of_every_piece(spark):
    """Pieces of rules repeated over a megabyte, open and closed, neither exhaust the stack nor lose a match."""
    n = 1_000_000
    many = lambda piece: piece * (n // len(piece))
    texts = [
        "-----BEGIN " + many("AB ") + "PRIVATE KEY-----", "-----BEGIN " + many("AB "), many("-----BEGIN "), many("PRIVATE KEY-----"),
        "token" + many(" ") + "= abcdefgh", "secret=" + many("a"), many("password"), many("AKIA"), many("0f"), "ghp_" + many("a"), many("ghp_"),
        "xoxb-" + many("1-"), "AIza" + many("-"), "bearer " + many("t."), "bearer" + many(" "), "://" + many("u") + ":" + many("p") + "@", many("://a:"),
        "eyJ" + many("a") + ".eyJ" + many("b") + "." + many("c"),
    ]
    rows = list(enumerate(texts))
    got = {r[0]: r[1:] for r in ours(spark, rows)}
    assert got == {d: plain(t) for d, t in rows}


def test_smallest_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = ours(spark, rows)
    assert got == sorted(((d, *plain(t)) for d, t in rows), key=repr)


def test_empty_table_and_no_python(spark):
    assert ours(spark, []) == []
    df = spark.createDataFrame([(1, "secret: abcdef", 3)], "doc_id bigint, text string, spans int")
    out = secrets.secret_report(df)
    assert out.first().n_assign == 1
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_trigram_queries():
    q = lambda p: sorted("&".join(sorted(c)) for c in trigrams.query(p))
    assert q("abcd") == ["abc&bcd"]
    assert q("ab?cd|wxyz") == ["abc&bcd", "acd", "wxy&xyz"]
    assert q("(?:foo|ba)[0-9]+barn") == ["arn&bar"] or q("(?:foo|ba)[0-9]+barn") == ["arn&bar&foo", "arn&bar"]
    assert q("[a-z]+") == q("a|bcd") == q("ab.cd") == [""]
    assert q("x[AB]y") == ["xay", "xby"]
    assert q("(abc)+d") == ["abc"]


def test_queries_never_miss_a_match():
    r = random.Random(3)
    for rule in secrets.RULES:
        clauses = trigrams.query(rule.pattern)
        regex = re.compile(rule.pattern, re.A | (re.I if rule.any_case else 0))
        for _, text in made(r.randrange(1000), 400):
            if regex.search(text):
                assert any(c <= trigrams.trigrams(text.lower()) for c in clauses)
