"""SQL for the queries that it can express, written for the checking engine."""

from __future__ import annotations

from sheaf.llm import chat, rollup
from sheaf.llm.licenses import MIN_COVER, PHRASES, TEMPLATES, key_places, word_list
from sheaf.llm.quality import LINE_LIMIT, MIN_SHARE, MIN_WORDS
from sheaf.llm.secrets import BASE, RULES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _rule(rank: int) -> str:
    """Spans of one rule: lengths of the pieces between matches and of the matches, added up."""
    rule = RULES[rank]
    regex = "'" + rule.regex.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + len(found[i]) AS stop FROM (
      SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {regex}, 0) AS found, regexp_extract_all(text, {regex}, {rule.group}) AS part,
          string_split_regex(text, {regex}) AS gaps FROM documents WHERE regexp_matches(text, {regex}))))
      WHERE len(part[i]) >= {rule.least}"""


def _spans(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({where}), '')"


SECRETS = f"""WITH spans AS ({" UNION ALL ".join(_rule(i) for i in range(len(RULES)))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  sha256({_spans(f"rank < {len(BASE)}")}) AS base_sha256, {_spans("rank >= 0")} AS spans
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

QUALITY = rf"""WITH counted AS (
  SELECT doc_id, source, text, {_WORDS.format("text")} AS w, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM counted)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE (doc_id, five) IN (
    SELECT (doc_id, five) FROM windows GROUP BY doc_id, five HAVING count(*) > 1)) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, line, {_WORDS.format(_LOW.format("line"))} AS lw FROM (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents)),
full_lines AS (SELECT *, array_to_string(lw, ' ') AS normal FROM lines WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
frequent AS (SELECT source, normal FROM full_lines GROUP BY source, normal HAVING count(DISTINCT text) > {LINE_LIMIT}),
lost AS (SELECT doc_id, sum(len(lw)) AS n FROM full_lines l JOIN frequent f ON l.source = f.source AND l.normal = f.normal GROUP BY doc_id),
base AS (SELECT c.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, n_symbols, coalesce(d.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS lost_words
  FROM counted c LEFT JOIN dups d USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost x USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - lost_words >= {MIN_WORDS} AND n_words - lost_words >= {MIN_SHARE} * n_words AS kept FROM judged"""

_TOKENS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW.format("text"))

DECONTAMINATION = f"""WITH items AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
parts AS (SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS span FROM (
  SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 13) AS size FROM items WHERE len(w) > 0))),
docs AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM parts),
found AS (SELECT doc_id, i, size, span FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS span FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes))
  WHERE (size, span) IN (SELECT (size, span) FROM parts)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM found JOIN parts USING (size, span) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(l), 0) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)"""

NEGATIVES = """WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT * FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
neg AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.alike AND 80 * p.s <= 100 * n.s AND n.s <= p.s)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM neg WHERE rank <= 5"""


def _values(rows: list[tuple]) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join(f"({', '.join(one(x) for x in r)})" for r in rows)


def _template_rows() -> list[tuple]:
    rows = []
    for k, t in enumerate(TEMPLATES):
        own, keys = word_list(t.text), set(key_places(t))
        rows += [(k, t.label, i, w, i in keys, len(keys), len(own)) for i, w in enumerate(own)]
    return rows


LICENSES = f"""WITH docs AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
template(tid, label, p, word, is_key, n_keys, size) AS ({_values(_template_rows())}),
phrase(label, p, word, size) AS ({_values([(label, i, w, len(word_list(x))) for x, label in PHRASES for i, w in enumerate(word_list(x))])}),
places AS (SELECT doc_id, label, pos - p AS start FROM tok JOIN phrase USING (word) GROUP BY doc_id, label, pos - p, size HAVING count(*) = size),
finds AS (SELECT doc_id, label, count(*) / size AS cover FROM tok JOIN template USING (word)
  GROUP BY doc_id, tid, label, pos - p, size, n_keys HAVING count(*) FILTER (is_key) = n_keys),
labelled AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM finds WHERE cover >= {MIN_COVER}),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY doc_id),
best AS (SELECT doc_id, max(cover) AS score FROM finds GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op3_token_counts": rollup.SQL,
    "op7_chat": chat.SQL,
    "op8_decontaminate": DECONTAMINATION,
    "op9_secrets": SECRETS,
    "op10_quality": QUALITY,
    "op12_hard_negatives": NEGATIVES,
    "op13_licenses": LICENSES,
}
