"""The SQL every query is checked against, written for the checking engine.

Each text states the expected result over the given tables in its own way: with windows over whole
bundles, lists and plain joins, none of which the Spark side relies on.
"""

from __future__ import annotations

from catalog.inputs import (
    ARRIVALS,
    BYTE_DOCS,
    DIRTY_FILES,
    DOC_FILES,
    HEADINGS,
    LEGACY_TEXT,
    PAGE_FILES,
    PATH_STREAM,
    RULE_LINES,
    TURN_STREAM,
)
from catalog.queries import BY_SITE, IN_USE, OFFERS, ON_THE_WAY, OUT_IN_USE, REQUESTS, SEQ_SPAN, SOURCES


def _with(*ctes: tuple[str, str], select: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in ctes) + " " + select


DOCS = ("doc_files", DOC_FILES)
DIRTY = ("dirty_files", DIRTY_FILES)
PAGES = ("page_files", PAGE_FILES)
TURNS = ("turn_stream", TURN_STREAM)
PATHS = ("path_stream", PATH_STREAM)
HEADS = ("headings", HEADINGS)

# Built-in rules as one list; a rule with a star is met by a suffix, one without by a whole name.
DEFAULT_NAMES = (
    "'node_modules','target','Thumbs.db','__pycache__','dist','build','vendor',"
    "'package-lock.json','yarn.lock','Cargo.lock'"
)
DEFAULT_SUFFIXES = (
    "exe|dll|so|dylib|bin|pdf|zip|docx|tar|gz|7z|rar|png|jpg|jpeg|gif|ico|svg|webp|bmp|tiff|"
    "ttf|otf|woff|woff2|eot|mp3|mp4|avi|mov|wav|flac|aac|ogg|o|obj|lib|a|pyc|tmp|bak|swp|swo"
)


def default_hit(path: str) -> str:
    return (
        f"len(list_filter(string_split({path}, '/'), lambda c: c LIKE '.%' OR c IN ({DEFAULT_NAMES})"
        f" OR regexp_full_match(c, '.*[.]({DEFAULT_SUFFIXES})'))) > 0"
    )


SPACES = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


# ---- rules ----------------------------------------------------------------------------------

LINES = ("rule_lines", RULE_LINES)
UNESCAPE = "regexp_replace({0}, '\\\\(.)', '\\1', 'g')"
PARSED = (
    "parsed",
    f"""SELECT ruleset_id, line_no AS rule_ord, {UNESCAPE.format("rtrim_one")} AS pattern, negated,
      body LIKE '%/' AS directory_only, rtrim_one LIKE '/%' AND rtrim_one NOT LIKE '//%' AS anchored
    FROM (SELECT *, CASE WHEN body LIKE '%/' THEN left(body, len(body) - 1) ELSE body END AS rtrim_one
      FROM (SELECT *, t LIKE '!%' AS negated, CASE WHEN t LIKE '!%' THEN substr(t, 2) ELSE t END AS body
        FROM (SELECT *, {trimmed("line")} AS t FROM rule_lines)
        WHERE t <> '' AND t NOT LIKE '#%'))""",
)


def glob_sql(p: str, tail: str) -> str:
    """Regex of a glob: stars are marked, the rest is quoted, marks become wildcards."""
    marked = f"regexp_replace(regexp_replace({p}, '[*][*]$', chr(1)), '[*][*]/', chr(2), 'g')"
    quoted = f"regexp_replace(translate({marked}, '*?', chr(3) || chr(4)), '([^A-Za-z0-9/_ \\x01-\\x04-])', '[\\1]', 'g')"
    for n, regex in ((1, tail), (2, "(?:.*/)?"), (3, "[^/]*"), (4, "[^/]")):
        quoted = f"replace({quoted}, chr({n}), '{regex}')"
    return f"({quoted})"


RULE_HIT = f"""CASE WHEN pattern = '' THEN false
  WHEN (anchored OR contains(pattern, '/')) AND directory_only THEN path = ltrim_one OR starts_with(path, ltrim_one || '/')
  WHEN anchored OR contains(pattern, '/') THEN regexp_full_match(path, {glob_sql("ltrim_one", ".*")})
  WHEN directory_only THEN len(list_filter(string_split(path, '/'), lambda c: regexp_full_match(c, {glob_sql("pattern", ".*")}))) > 0
  ELSE regexp_full_match(path, {glob_sql("pattern", ".*")})
    OR len(list_filter(string_split(path, '/'), lambda c: regexp_full_match(c, {glob_sql("pattern", ".*")}))) > 0 END"""

HITS = (
    "hits",
    f"""SELECT * FROM (SELECT bundle_id, path, rule_ord, pattern, negated, {RULE_HIT} AS hit
    FROM (SELECT d.bundle_id, d.path, r.*, regexp_replace(r.pattern, '^/', '') AS ltrim_one
      FROM doc_files d JOIN parsed r ON d.bundle_id = r.ruleset_id)) WHERE hit""",
)
DECIDED = (
    "decided",
    "SELECT bundle_id, path, arg_max(pattern, rule_ord) AS pattern, arg_max(negated, rule_ord) AS negated,"
    " max(rule_ord) AS rule_ord FROM hits GROUP BY bundle_id, path",
)

# ---- bytes ----------------------------------------------------------------------------------


def units(fmt: str) -> str:
    return f"array_to_string(list_transform(string_split(text, ''), lambda c: {fmt}), '')"


LE16 = units("printf('%02X%02X', unicode(c) % 256, unicode(c) // 256)")
BE16 = units("printf('%04X', unicode(c))")
# Bytes of the Chinese form, of which only number and kind count: some accents take two, others four.
GB = units("CASE WHEN unicode(c) < 128 THEN printf('%02X', unicode(c)) WHEN c IN ('é', 'è', 'ê', 'ü', 'ó', 'í') THEN 'A8A6' ELSE '81308135' END")
BYTES = (
    "byte_files",
    f"""SELECT bundle_id, path, doc_id, text, form, hx, len(hx) // 2 AS length, left(hx, 16384) AS hd,
      least(len(hx) // 2, 8192) AS n FROM (
    SELECT *, CASE WHEN doc_id < 0 THEN -1 ELSE doc_id % 9 END AS form,
      CASE WHEN doc_id < 0 THEN '' ELSE CASE doc_id % 9 WHEN 0 THEN hex(text) WHEN 1 THEN 'EFBBBF' || hex(text)
      WHEN 2 THEN {LE16} WHEN 3 THEN {BE16} WHEN 4 THEN 'FFFE' || {LE16}
      WHEN 5 THEN {units("printf('%08X', unicode(c))")} WHEN 6 THEN {GB}
      WHEN 7 THEN hex(replace(text, ' ', chr(0))) ELSE hex(translate(text, 'ea', chr(1) || chr(1))) END END AS hx
    FROM ({BYTE_DOCS}))""",
)
PRINTABLE = "(2[1-9A-F]|[3-6].|7[0-9A-E]|20|09|0A|0C|0D)"


def unit_count(units_list: str, regex: str) -> str:
    return f"len(list_filter({units_list}, lambda u: regexp_full_match(u, '{regex}')))"


SCORES = (
    "scores",
    f"""SELECT *, {unit_count("pairs", "([1-9A-F].|0[1-9A-F])00")} AS le16, {unit_count("pairs", "00([1-9A-F].|0[1-9A-F])")} AS be16,
      {unit_count("quads", "([1-9A-F].|0[1-9A-F])000000")} AS le32, {unit_count("quads", "000000([1-9A-F].|0[1-9A-F])")} AS be32,
      {unit_count("pairs[1:2048]", PRINTABLE + "..")} AS print_le, {unit_count("pairs[1:2048]", ".." + PRINTABLE)} AS print_be,
      len(list_filter(pairs, lambda u: regexp_full_match(u, '..D[89A-F]'))) AS sur_le,
      len(list_filter(pairs, lambda u: regexp_full_match(u, 'D[89A-F]..'))) AS sur_be,
      len(list_filter(singles, lambda b: b = '00')) > 0 AS has_nul,
      hd LIKE 'EFBBBF%' OR hd LIKE 'FFFE%' OR hd LIKE 'FEFF%' AS has_bom,
      regexp_full_match(hd, '([0-7].|(C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-F]([89AB].){{2}}|F[0-4]([89AB].){{3}})*') AS utf8
    FROM (SELECT *, regexp_extract_all(hd, '.{{4}}') AS pairs, regexp_extract_all(hd, '.{{8}}') AS quads,
      regexp_extract_all(hd, '..') AS singles FROM byte_files)""",
)
# No unit is a surrogate in these data, so a clean decode is the absence of any.
WIDE = (
    "wide",
    """SELECT *, n >= 4 AND n % 2 = 0 AND le16 + be16 >= least(n // 2, 4096) // 4 AND CASE
        WHEN le16 > be16 * 5 THEN sur_le = 0 AND print_le > least(n, 4096) // 4
        WHEN be16 > le16 * 5 THEN sur_be = 0 AND print_be > least(n, 4096) // 4 ELSE false END AS utf16,
      n >= 8 AND n % 4 = 0 AND le32 + be32 > least(n // 4, 2048) // 4 AND (le32 > be32 * 3 OR be32 > le32 * 3) AS utf32,
      len(list_filter(singles, lambda b: NOT regexp_full_match(b, '[89AB].'))) AS starts,
      len(list_filter(singles, lambda b: regexp_full_match(b, '0[0-8BEF]|1.|7F'))) AS controls,
      len(list_filter(singles, lambda b: regexp_full_match(b, '[89A-F].'))) AS high,
      form = 6 AND regexp_full_match(hd, '([0-7].|A8A6|81308135)*') AS whole,
      regexp_full_match(hd, CASE WHEN form = 6 THEN '([0-7].|A8A6)*(A8)?' ELSE '([0-7].|C3[AB].)*(C3)?' END) AS kana FROM scores""",
)
# What is not UTF-8 goes down the ladder. A prefix that ends within a character is no Chinese text; its bytes are Japanese
# letters, one each, unless an accent takes another form. What is left has a bad character for each stray byte.
REASONS = (
    "reasons",
    """SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN has_bom THEN 'bom' WHEN has_nul AND utf16 THEN 'utf16'
      WHEN has_nul AND utf32 THEN 'utf32' WHEN has_nul THEN 'nul'
      WHEN utf8 AND controls * 10 <= starts THEN 'utf8'
      WHEN whole AND NOT utf8 THEN 'GBK'
      WHEN kana AND controls * 10 <= n THEN 'SHIFT_JIS'
      WHEN NOT utf8 AND form = 6 AND high * 10 <= n THEN 'lossy'
      WHEN NOT utf8 AND form <> 6 AND (controls + 1) * 10 <= starts THEN 'lossy'
      ELSE 'binary' END AS reason FROM wide""",
)
SNIFFED = (DOCS, BYTES, SCORES, WIDE, REASONS)

ASCII = "NOT regexp_matches(text, '[^\\x00-\\x7F]')"
LATIN_LOST = "regexp_replace(text, '[\\x{80}-\\x{FF}]', chr(65533), 'g')"


# Accents of capitals, and sharp s: as bytes they are Japanese letters.
KANA = "array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 127 THEN chr(unicode(c) + 65216) ELSE c END), '')"
IS_KANA = "NOT regexp_matches(text, '[\\x{E0}-\\x{FF}]')"


def spaced(before: int, after: int) -> str:
    """Text with lost accents (or the letters read for them) and zero characters around every character, as
    wide bytes read by the character."""
    pad = lambda k: " || ".join(["chr(0)"] * k)
    parts = [p for p in (pad(before), "c", pad(after)) if p]
    read = f"CASE WHEN {IS_KANA} THEN {KANA} ELSE {LATIN_LOST} END"
    return f"array_to_string(list_transform(string_split({read}, ''), lambda c: {' || '.join(parts)}), '')"


DECODED = (
    "decoded",
    f"""SELECT *, CASE form WHEN -1 THEN '' WHEN 0 THEN text WHEN 1 THEN chr(65279) || text WHEN 2 THEN {spaced(0, 1)}
      WHEN 3 THEN {spaced(1, 0)} WHEN 4 THEN text WHEN 5 THEN {spaced(3, 0)}
      WHEN 6 THEN text WHEN 7 THEN replace(text, ' ', chr(0)) ELSE translate(text, 'ea', chr(1) || chr(1)) END AS out,
      CASE WHEN form = 4 THEN 'GBK' WHEN form IN (-1, 0, 1, 7, 8) OR {ASCII} THEN 'UTF-8' WHEN form = 6 THEN 'GBK'
        WHEN {IS_KANA} THEN 'SHIFT_JIS' ELSE 'UTF-8-LOSSY' END AS encoding
    FROM byte_files""",
)
LEGACY = ("legacy", f"""SELECT *, {LEGACY_TEXT} AS body FROM (SELECT doc_id, text, regexp_replace(text, concat('[^ -~', chr(10), ']+'), '', 'g') AS plain FROM doc_files)""")

# ---- rows -----------------------------------------------------------------------------------


def lines_of(text: str) -> str:
    """Lines as a list: cut at LF, no piece after a final LF, a CR before LF gone."""
    pieces = f"string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN {text} LIKE '%' || chr(10) THEN {pieces}[:-2] ELSE {pieces} END"


def paragraphs_of(source: str, extra: str = "") -> str:
    return f"""SELECT bundle_id, path{extra}, unnest(list_concat([path], lines)) AS text,
      generate_subscripts(list_concat([path], lines), 1) - 1 AS line_no
    FROM (SELECT *, {lines_of("text")} AS lines FROM {source})"""


DIRTY_ROWS = ("dirty_rows", paragraphs_of("dirty_files", ", doc_id"))
STYLE = "CASE WHEN line_no = 0 THEN 'Heading1' END"


def escaped(text: str) -> str:
    out = f"regexp_replace({text}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{char}', '{entity}')"
    return f"replace(replace({out}, chr(39), '&apos;'), chr(13), '&#xD;')"


def fragment(style: str, text: str) -> str:
    return (
        f"'<w:p>' || CASE WHEN {style} LIKE 'Heading%' THEN '<w:pPr><w:pStyle w:val=\"' || {style} || '\"/></w:pPr>' ELSE '' END"
        f" || array_to_string(list_transform(string_split({escaped(text)}, chr(10)),"
        f" lambda l: '<w:r><w:t>' || l || '</w:t></w:r>'), '<w:br/>') || '</w:p>'"
    )


CONTROLS = "'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'"
NORMAL = f"rtrim(array_to_string({lines_of('text')}, chr(10)), chr(10))"

# ---- segments -------------------------------------------------------------------------------


def segments(stream: str) -> str:
    return f"""SELECT *, count(CASE WHEN style LIKE 'Heading%' THEN 1 END)
      OVER (PARTITION BY bundle_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg_no FROM {stream}"""


def folded(source: str, keep: str = "") -> str:
    return f"""SELECT bundle_id, seg_no{keep}, max(CASE WHEN style LIKE 'Heading%' THEN text END) AS heading,
      rtrim(coalesce(string_agg(CASE WHEN style IS NULL THEN text END, chr(10) ORDER BY seq), ''), chr(10)) AS content
    FROM {source} WHERE seg_no > 0 GROUP BY bundle_id, seg_no{keep}"""


RESERVED = "'CON','PRN','AUX','NUL'," + ",".join(f"'COM{i}','LPT{i}'" for i in range(1, 10))


def checked(source: str) -> str:
    """path and error of ``heading``."""
    return f"""SELECT * EXCLUDE (p, bad), CASE WHEN error IS NULL THEN regexp_replace(p, '[<>:"|?*\\x00]', '_', 'g') END AS path
    FROM (SELECT *, CASE WHEN p = '' THEN 'empty' WHEN p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:(/|$)') THEN 'absolute'
        WHEN bad = '..' THEN 'traversal' WHEN bad IS NOT NULL THEN 'reserved' END AS error
      FROM (SELECT *, list_filter(string_split(p, '/'),
          lambda c: c = '..' OR upper(regexp_replace(c, '[.][^.]*$', '')) IN ({RESERVED}))[1] AS bad
        FROM (SELECT *, replace({trimmed("heading")}, chr(92), '/') AS p FROM {source})))"""


IDENTITY = "array_to_string(list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.')), '/')"
PATH_SEGMENTS = (
    PATHS,
    ("segs", segments("path_stream")),
    ("folds", folded("segs", ", bundle_ord")),
    ("named", checked("(SELECT * FROM folds WHERE heading <> '')")),
)
STRICT = (
    "strict",
    "SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM named b WHERE b.bundle_id = n.bundle_id"
    " AND b.error IS NOT NULL AND b.seg_no <= n.seg_no)",
)

# ---- names ----------------------------------------------------------------------------------


def parent_of(p: str) -> str:
    kept = f"rtrim({p}, '/')"
    return (
        f"CASE WHEN NOT contains({kept}, '/') THEN CASE WHEN {p} LIKE '/%' THEN '/' ELSE '' END"
        f" WHEN regexp_full_match({kept}, '/[^/]*') THEN '/'"
        f" ELSE left({kept}, len({kept}) - len(string_split({kept}, '/')[-1]) - 1) END"
    )


def name_of(p: str) -> str:
    return f"string_split(rtrim({p}, '/'), '/')[-1]"


def ext_cut(n: str) -> str:
    """Length of the extension with its dot; 0 if there is none."""
    return (
        f"CASE WHEN {n} = '..' OR NOT contains(substr({n}, 2), '.') THEN 0"
        f" ELSE len(string_split({n}, '.')[-1]) + 1 END"
    )


def stem_of(p: str) -> str:
    n = name_of(p)
    return f"left({n}, len({n}) - {ext_cut(n)})"


SOURCE_LIST = (DOCS, ("sources", SOURCES))
# A directory is common if it is an ancestor of every source; the longest such one wins.
COMMON = (
    "common",
    f"""SELECT bundle_id, count(DISTINCT source_ord) AS sources, max_common AS common_parent FROM sources
    LEFT JOIN (SELECT b AS bid, arg_max(dir, len(dir)) AS max_common FROM (
        SELECT bundle_id AS b, dir, count(DISTINCT source_ord) AS n FROM (
          SELECT bundle_id, source_ord, unnest(list_transform(range(1, len(parts) + 1),
            lambda i: array_to_string(parts[1:i], '/'))) AS dir
          FROM (SELECT *, string_split({parent_of("path")}, '/') AS parts FROM sources)) GROUP BY b, dir) a
      WHERE n = (SELECT count(DISTINCT source_ord) FROM sources s WHERE s.bundle_id = a.b) AND dir NOT IN ('', '/')
      GROUP BY b) m ON m.bid = bundle_id GROUP BY bundle_id, max_common""",
)


def joined(folder: str, name: str) -> str:
    return f"CASE WHEN {folder} = '' THEN {name} WHEN {folder} = '/' THEN '/' || {name} ELSE {folder} || '/' || {name} END"


NAMED = (
    "named_out",
    f"""SELECT bundle_id, CASE WHEN explicit <> 'output.docx' THEN explicit ELSE {joined("folder", "base || '.docx'")} END AS output_name
    FROM (SELECT c.bundle_id, explicit,
        CASE WHEN sources = 1 OR common_parent IS NULL THEN {parent_of("first_path")} ELSE common_parent END AS folder,
        CASE WHEN sources = 1 AND first_dir THEN {name_of("first_path")} WHEN sources = 1 THEN {stem_of("first_path")}
          WHEN common_parent IS NULL THEN 'output' ELSE {name_of("common_parent")} END AS base
      FROM common c JOIN (SELECT bundle_id, arg_min(path, source_ord) AS first_path, arg_min(is_dir, source_ord) AS first_dir,
        max(explicit) AS explicit FROM sources GROUP BY bundle_id) f ON f.bundle_id = c.bundle_id)""",
)

# Lists of lines without empty ones at the end, without blanks at both ends of lines, and without blank lines.
END = "rtrim(array_to_string({}, chr(10)), chr(10))"
BARE = "list_transform({}, lambda l: trim(l, ' ' || chr(9)))"
FULL = "list_filter({}, lambda l: trim(l, ' ' || chr(9)) <> '')"

# ---- the texts ------------------------------------------------------------------------------

# The custom rules from the last to the first; the first that hits decides. A folder rule with a
# slash inside is taken literally, star and all.
CUSTOM_HIT = f"""CASE
        WHEN starts_with(path, 'src2/') THEN false
        WHEN path = 'src*/target/de' OR starts_with(path, 'src*/target/de/') THEN true
        WHEN path LIKE '%.md' THEN false
        WHEN regexp_matches(path, '^src[^/]/src/(.*/)?1[^/]*$') THEN true
        WHEN regexp_matches(path, '(^|/)fr/[^/]*[.]txt$') THEN true
        WHEN starts_with(path, 'src1/logs/') THEN true
        WHEN path LIKE '%.log' THEN true
        ELSE {default_hit("path")} END"""

ORACLE: dict[str, str] = {
    "files_and_lines": _with(
        DOCS,
        select=f"""SELECT bundle_id, count(*) AS files, CAST(sum(len({lines_of("text")})) AS BIGINT) AS lines
        FROM doc_files WHERE NOT ({default_hit("path")}) GROUP BY bundle_id""",
    ),
    "scan_files": _with(
        DOCS, select="SELECT bundle_id, path, strlen(text) AS length, md5(text) AS content_md5 FROM doc_files"
    ),
    "scan_tree": _with(
        DOCS, select=f"SELECT path, strlen(text) AS length, md5(text) AS content_md5 FROM doc_files WHERE NOT {CUSTOM_HIT}"
    ),
    "scan_given_sources": _with(
        DOCS,
        ("numbered", "SELECT bundle_id, CAST(row_number() OVER (ORDER BY bundle_id) AS INT) AS source_ord FROM (SELECT DISTINCT bundle_id FROM doc_files)"),
        ("below", "SELECT source_ord, substr(path, len(bundle_id) + 2) AS path, text FROM doc_files JOIN numbered USING (bundle_id)"),
        select=f"""SELECT source_ord, false AS direct, path, strlen(text) AS length, md5(text) AS content_md5 FROM below WHERE NOT ({default_hit("path")})
        UNION ALL SELECT 0, true, {name_of("path")}, strlen(text), md5(text) FROM doc_files WHERE path = (SELECT min(path) FROM doc_files)""",
    ),
    "pack_given_tree": _with(
        DOCS,
        ("doc_rows", paragraphs_of("doc_files")),
        select=f"""SELECT path, count(*) AS rows, CAST(sum(len(text)) AS BIGINT) AS chars FROM doc_rows WHERE NOT {CUSTOM_HIT} GROUP BY path""",
    ),
    "scan_rule_files": _with(
        ("given", RULE_LINES),
        ("rule_lines", "SELECT ruleset_id, CAST(row_number() OVER (PARTITION BY ruleset_id ORDER BY line_no, line) - 1 AS INT) AS line_no, line FROM given"),
        PARSED,
        select="SELECT * FROM parsed",
    ),
    "scan_sources": _with(
        DOCS,
        PAGES,
        select=f"""SELECT bundle_id, CAST(0 AS INT) AS source_ord, false AS direct, path, strlen(text) AS length FROM doc_files
        WHERE NOT ({default_hit("path")}) UNION ALL
        SELECT bundle_id, CAST(page_id + 1 AS INT), true, {name_of("path")}, strlen(text) FROM page_files""",
    ),
    "sniff_prefix": _with(
        DOCS,
        select="""SELECT bundle_id, path, CAST(least(strlen(text), 8192) AS INT) AS head_bytes,
        md5(encode(text)[1:8192]) AS head_md5 FROM doc_files""",
    ),
    "bundle_roundtrip": _with(
        DIRTY,
        DIRTY_ROWS,
        select=f"""SELECT bundle_id, path, CAST(line_no AS INT) AS line_no, {STYLE} AS style, text FROM dirty_rows
        WHERE NOT ({default_hit("path")})""",
    ),
    "replace_bundles": _with(
        DIRTY,
        DIRTY_ROWS,
        ("ends", f"""SELECT min(bundle_id) AS x, max(bundle_id) AS y FROM dirty_rows WHERE NOT ({default_hit("path")})"""),
        ("shifted", f"""SELECT r.*, bundle_id IN (x, y) AS anew FROM dirty_rows r, ends
        WHERE NOT ({default_hit("path")}) AND NOT (bundle_id IN (x, y) AND path LIKE '%.md')"""),
        select=f"""SELECT bundle_id, path, CAST(line_no + CASE WHEN anew AND line_no > 0 THEN 1 ELSE 0 END AS INT) AS line_no, {STYLE} AS style, text
        FROM shifted UNION ALL SELECT bundle_id, path, 1, NULL, 'new' FROM shifted WHERE anew AND line_no = 0""",
    ),
    "replaced_bundle": _with(
        DIRTY,
        DIRTY_ROWS,
        ("shown", f"""SELECT * FROM dirty_rows WHERE NOT ({default_hit("path")})"""),
        select=f"""SELECT bundle_id, path, CAST(line_no AS INT) AS line_no, {STYLE} AS style, text FROM shown
        WHERE bundle_id = (SELECT min(bundle_id) FROM shown)""",
    ),
    "rules_parsed": _with(LINES, PARSED, select="SELECT * FROM parsed"),
    "rules_literal": _with(
        LINES,
        select="""SELECT ruleset_id, line_no AS rule_ord, line AS pattern, false AS negated,
        line LIKE '%/' AS directory_only, false AS anchored FROM rule_lines""",
    ),
    "rules_added": _with(
        LINES,
        select=f"""SELECT ruleset_id, line_no AS rule_ord, {UNESCAPE.format("CASE WHEN b LIKE '%/' THEN left(b, len(b) - 1) ELSE b END")} AS pattern,
        line LIKE '!%' AS negated, line LIKE '%/' AS directory_only, line LIKE '/%' AND line NOT LIKE '//%' AS anchored
        FROM (SELECT *, CASE WHEN line LIKE '!%' THEN substr(line, 2) ELSE line END AS b FROM rule_lines)""",
    ),
    "ruleset_precedence": _with(
        LINES,
        PARSED,
        ("offers", OFFERS),
        ("counting", """SELECT ruleset_id, n, bool_or(origin = 'text') AS typed, bool_or(origin = 'local') AS has_local FROM offers GROUP BY ruleset_id, n"""),
        # A set's typed-in lines stand alone; then its named, else its local file, else its settings.
        ("source", """SELECT *, CASE WHEN typed THEN 'text' WHEN n = 1 THEN 'named' WHEN n <> 2 AND has_local THEN 'local' ELSE 'settings' END AS chosen
            FROM counting"""),
        ("chosen", """SELECT o.ruleset_id, o.line_no, o.offer_ord, chosen, o.line, p.pattern, p.negated, p.directory_only, p.anchored
            FROM offers o JOIN source s ON s.ruleset_id = o.ruleset_id AND o.origin = s.chosen
            LEFT JOIN parsed p ON p.ruleset_id = o.ruleset_id AND p.rule_ord = o.line_no
            WHERE chosen = 'settings' OR p.pattern IS NOT NULL"""),
        ("builtin", f"""SELECT unnest(list_concat(['.*', {DEFAULT_NAMES}],
            list_transform(string_split('{DEFAULT_SUFFIXES}', '|'), lambda s: '*.' || s))) AS pattern,
            generate_subscripts(range(0, 54), 1) - 1 AS ord"""),
        ("blank", f"""SELECT ruleset_id FROM offers WHERE origin = 'text' GROUP BY ruleset_id HAVING bool_and({trimmed("line")} = '')"""),
        select="""SELECT ruleset_id, CAST(ord AS INT) AS rule_ord, pattern, false AS negated, false AS directory_only, false AS anchored
        FROM builtin CROSS JOIN (SELECT ruleset_id FROM source WHERE NOT typed OR ruleset_id IN (FROM blank))
        UNION ALL SELECT ruleset_id, CAST(row_number() OVER (PARTITION BY ruleset_id ORDER BY offer_ord, line_no) - 1
            + CASE WHEN chosen = 'text' THEN 0 ELSE 54 END AS INT),
          CASE WHEN chosen = 'settings' THEN line ELSE pattern END, CASE WHEN chosen = 'settings' THEN false ELSE negated END,
          CASE WHEN chosen = 'settings' THEN line LIKE '%/' ELSE directory_only END, CASE WHEN chosen = 'settings' THEN false ELSE anchored END
        FROM chosen""",
    ),
    "glob_cases": _with(DOCS, LINES, PARSED, HITS, select="""SELECT d.path, CAST(count(h.path) AS INT) AS hits, CAST(max(h.rule_ord) AS INT) AS last_hit
        FROM doc_files d LEFT JOIN hits h ON h.path = d.path GROUP BY d.path"""),
    "exclude_default": _with(
        DOCS, select=f"SELECT bundle_id, path FROM doc_files WHERE NOT ({default_hit('path')})"
    ),
    "exclude_custom": _with(DOCS, select=f"SELECT bundle_id, path FROM doc_files WHERE NOT {CUSTOM_HIT}"),
    "exclude_join": _with(
        DOCS, LINES, PARSED, HITS, DECIDED,
        select="""SELECT bundle_id, path FROM doc_files
        WHERE (bundle_id, path) NOT IN (SELECT (bundle_id, path) FROM decided WHERE NOT negated)""",
    ),
    "exclusion_audit": _with(
        DOCS, LINES, PARSED, HITS, DECIDED,
        select="""SELECT bundle_id, rule_ord, pattern, negated, count(*) AS paths FROM decided
        GROUP BY bundle_id, rule_ord, pattern, negated""",
    ),
    "pattern_list": _with(LINES, PARSED, select="SELECT ruleset_id, rule_ord, pattern FROM parsed"),
    "sniff_bom": _with(*SNIFFED, select="SELECT doc_id, has_bom FROM reasons"),
    "sniff_nul": _with(*SNIFFED, select="SELECT doc_id, has_nul FROM reasons"),
    "sniff_utf16": _with(
        *SNIFFED,
        select="SELECT doc_id, CAST(le16 AS INT) AS le_units, CAST(be16 AS INT) AS be_units, utf16 FROM reasons",
    ),
    "sniff_utf32": _with(
        *SNIFFED,
        select="SELECT doc_id, CAST(le32 AS INT) AS le_units, CAST(be32 AS INT) AS be_units, utf32 FROM reasons",
    ),
    "meaningful_ratio": """SELECT doc_id, CAST(bad AS INT) AS bad, CAST(total AS INT) AS total, bad * 10 <= total AS meaningful
      FROM (SELECT doc_id, len(text) AS total, (len(text) - len(replace(text, '. ', ''))) + len(list_filter(
        string_split(replace(text, '. ', ''), ''), lambda c: c IN ('e', 'z', 'k'))) AS bad FROM documents)""",
    "classify_files": _with(
        *SNIFFED,
        select="SELECT doc_id, reason, reason NOT IN ('nul', 'binary') AS is_text FROM reasons",
    ),
    "text_filter": _with(
        *SNIFFED, select="SELECT bundle_id, path, length FROM reasons WHERE reason NOT IN ('nul', 'binary')"
    ),
    "decode_ladder": f"SELECT doc_id, text, CASE WHEN {ASCII} THEN 'UTF-8' ELSE 'GBK' END AS encoding FROM documents",
    "decode_legacy": _with(
        DOCS, LEGACY,
        select="""SELECT doc_id, body || CASE doc_id % 6 WHEN 0 THEN chr(128) WHEN 1 THEN '가' WHEN 2 THEN 'c' || chr(129) || 'é'
            WHEN 3 THEN '€' WHEN 4 THEN chr(65533) ELSE chr(63393) || chr(63423) END AS text,
          CASE doc_id % 6 WHEN 0 THEN 'SHIFT_JIS' WHEN 1 THEN 'EUC-KR' WHEN 2 THEN 'WINDOWS-1252' WHEN 3 THEN 'GBK'
            WHEN 4 THEN 'UTF-8-LOSSY' ELSE 'X-USER-DEFINED' END AS encoding FROM legacy""",
    ),
    "decode_text": _with(
        DOCS, BYTES, DECODED,
        select="SELECT doc_id, md5(out) AS text_md5, CAST(len(out) AS INT) AS chars, encoding FROM decoded",
    ),
    # What passes for two-byte text is read as such, even if it was made otherwise.
    "decode_wide": _with(
        *SNIFFED, DECODED,
        select="""SELECT doc_id, md5(t) AS text_md5, CAST(len(t) AS INT) AS chars, e AS encoding FROM (
        SELECT d.doc_id, CASE reason WHEN 'utf32' THEN d.text WHEN 'utf16' THEN array_to_string(list_transform(
            regexp_extract_all(d.hx, '..(..)?'), lambda u: chr(CAST('0x' || CASE WHEN le16 > be16 THEN u[3:4] || u[1:2] ELSE u END AS INT))), '')
            ELSE out END AS t,
          CASE WHEN reason = 'utf16' THEN CASE WHEN le16 > be16 THEN 'UTF-16LE' ELSE 'UTF-16BE' END
            WHEN reason = 'utf32' THEN CASE WHEN le32 > be32 THEN 'UTF-32LE' ELSE 'UTF-32BE' END ELSE encoding END AS e
        FROM decoded d JOIN (SELECT doc_id, reason, le16, be16, le32, be32 FROM reasons) r USING (doc_id))""",
    ),
    "encoding_audit": _with(
        *SNIFFED, DECODED,
        select="""SELECT bundle_id, reason, encoding, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
          CAST(grouping(bundle_id, reason, encoding) AS INT) AS level FROM (
          SELECT r.bundle_id, reason, CASE WHEN reason IN ('nul', 'binary') THEN 'none' ELSE encoding END AS encoding, r.length
          FROM reasons r JOIN (SELECT doc_id, encoding FROM decoded) d USING (doc_id))
        GROUP BY ROLLUP (bundle_id, reason, encoding)""",
    ),
    "explode_lines": _with(
        DIRTY, DIRTY_ROWS,
        select="SELECT path, CAST(line_no AS INT) AS line_no, text FROM dirty_rows WHERE line_no > 0",
    ),
    "build_paragraphs": _with(
        DIRTY, DIRTY_ROWS,
        select=f"""SELECT bundle_id, CAST(0 AS INT) AS source_ord, path, CAST(line_no AS INT) AS line_no,
        {STYLE} AS style, text FROM dirty_rows""",
    ),
    "heading_counts": _with(
        TURNS,
        select="""SELECT bundle_id, count(CASE WHEN seq % 3 = 0 THEN 1 END) AS headings, count(*) AS rows
        FROM turn_stream GROUP BY bundle_id""",
    ),
    "path_normalize": _with(PAGES, HEADS, select="SELECT id, replace(heading, chr(92), '/') AS path FROM headings"),
    "bundle_header": f"""SELECT bundle_id, {escaped("h")} AS markup, CASE WHEN h <> '' THEN h END AS header FROM (
      SELECT conv_id AS bundle_id, unnest([max(CASE WHEN turn = 0 THEN CASE WHEN role = 'system' THEN text ELSE '' END END),
        max(CASE WHEN turn > 3 THEN '<&' || chr(39) || chr(34) || '>' || chr(13) || role END)]) AS h
      FROM conversations GROUP BY conv_id)""",
    "clean_text": _with(
        DIRTY, PAGES,
        select=f"""SELECT 'doc' AS kind, doc_id AS id, {escaped("text")} AS text FROM dirty_files UNION ALL
        SELECT 'page', page_id, {escaped("text")} FROM page_files""",
    ),
    "render_paragraphs": _with(
        TURNS, select=f"SELECT bundle_id, seq, {fragment('style', 'text')} AS fragment FROM turn_stream"
    ),
    "assemble_bundle": _with(
        DIRTY, DIRTY_ROWS,
        ("fragments", f"SELECT *, {fragment(f'({STYLE})', 'text')} AS fragment FROM dirty_rows"),
        select="""SELECT bundle_id, CAST(0 AS INT) AS source_ord, path, CAST(0 AS INT) AS first_line,
        md5(body) AS body_md5, CAST(len(body) AS INT) AS chars FROM (
        SELECT bundle_id, path, string_agg(fragment, '' ORDER BY line_no) AS body FROM fragments GROUP BY bundle_id, path)""",
    ),
    "parse_markup": _with(
        DIRTY, DIRTY_ROWS,
        select=f"""SELECT bundle_id, CAST(0 AS INT) AS source_ord, path, CAST(line_no AS INT) AS line_no,
        {STYLE} AS style, regexp_replace(text, {CONTROLS}, '', 'g') AS text FROM dirty_rows""",
    ),
    "parse_foreign": f"""SELECT doc_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS style,
      'a B' || chr(128512) || ' &#67;' || chr(9) || chr(10) || regexp_replace(replace(text, chr(10), ' '), {CONTROLS}, '', 'g') AS text FROM documents""",
    "segment_turns": _with(
        TURNS, ("segs", segments("turn_stream")), select="SELECT bundle_id, seq, seg_no FROM segs WHERE seg_no > 0"
    ),
    "segment_docs": _with(
        DIRTY, DIRTY_ROWS,
        ("stream", f"SELECT bundle_id, doc_id * {SEQ_SPAN} + line_no AS seq, {STYLE} AS style FROM dirty_rows"),
        ("segs", segments("stream")),
        select="SELECT bundle_id, seg_no, count(*) AS rows, max(seq) AS last_seq FROM segs GROUP BY bundle_id, seg_no",
    ),
    "unpack_files": _with(
        DIRTY, select=f"SELECT bundle_id, path, CAST(0 AS BIGINT) AS part_no, {NORMAL} AS content FROM dirty_files WHERE NOT ({default_hit('path')})"
    ),
    "unpack_seq": _with(
        DIRTY,
        select=f"""SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY doc_id) AS seg_no, path, CAST(0 AS BIGINT) AS part_no,
        {NORMAL} AS content FROM dirty_files""",
    ),
    "unpack_sparse": _with(
        DIRTY,
        select=f"""SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY doc_id) AS seg_no, path, CAST(0 AS BIGINT) AS part_no,
        {NORMAL} AS content FROM dirty_files""",
    ),
    "unpack_compat": _with(
        DIRTY,
        select=f"""SELECT bundle_id, path, CAST(0 AS BIGINT) AS part_no, rtrim(array_to_string(list_transform({lines_of("text")}, lambda l:
        trim(regexp_replace(l, {CONTROLS}, '', 'g'), ' ' || chr(9))), chr(10)), chr(10)) AS content FROM dirty_files""",
    ),
    "unpack_edge": _with(
        *PATH_SEGMENTS, select="SELECT bundle_id, seg_no, CAST(0 AS BIGINT) AS part_no, heading, content FROM folds WHERE heading <> ''"
    ),
    "validate_paths": _with(
        PAGES, HEADS, ("c", checked("headings")), select="SELECT id, path, error FROM c"
    ),
    "unpack_strict": _with(
        *PATH_SEGMENTS, STRICT, select="SELECT bundle_id, seg_no, path, CAST(0 AS BIGINT) AS part_no, content FROM strict"
    ),
    "unpack_dedup": _with(
        *PATH_SEGMENTS,
        select=f"""SELECT bundle_id, seg_no, path, CAST(0 AS BIGINT) AS part_no, content FROM (SELECT *, row_number() OVER (
        PARTITION BY bundle_id, {IDENTITY} ORDER BY seg_no DESC) AS nth FROM named WHERE error IS NULL) WHERE nth = 1""",
    ),
    "unpack_summary": _with(
        *PATH_SEGMENTS, STRICT,
        select="SELECT bundle_id, count(*) AS file_count FROM strict GROUP BY ROLLUP (bundle_id)",
    ),
    "unpack_outcome": _with(
        *PATH_SEGMENTS, STRICT,
        select="""SELECT bundle_id, count(*) FILTER (s.seg_no IS NOT NULL) AS file_count,
          arg_min(n.error, n.seg_no) FILTER (n.error IS NOT NULL) AS error
        FROM named n LEFT JOIN strict s USING (bundle_id, seg_no) GROUP BY bundle_id""",
    ),
    "unpack_batch": _with(
        *PATH_SEGMENTS, STRICT,
        ("late", "SELECT bundle_id, -abs(bundle_ord - 40) AS o FROM named WHERE error IS NOT NULL"),
        select="""SELECT bundle_id, path FROM strict
        WHERE -abs(bundle_ord - 40) <= coalesce((SELECT min(o) FROM late), 9223372036854775807)""",
    ),
    "duplicate_paths": _with(
        PAGES,
        select="""SELECT bundle_id, path, count(*) AS copies, CAST(list_sort(list(page_id))[2] AS INT) AS repeat_ord
        FROM page_files GROUP BY bundle_id, path HAVING count(*) > 1""",
    ),
    "first_duplicate": _with(
        PAGES,
        select="""SELECT bundle_id, arg_min(path, repeat_ord) AS path, count(*) AS repeated_paths FROM (
        SELECT bundle_id, path, list_sort(list(page_id))[2] AS repeat_ord
        FROM page_files GROUP BY bundle_id, path HAVING count(*) > 1) GROUP BY bundle_id""",
    ),
    "reject_duplicates": _with(
        ("by_site", BY_SITE),
        select="""SELECT * FROM by_site WHERE bundle_id NOT IN (
        SELECT bundle_id FROM by_site GROUP BY bundle_id, path HAVING count(*) > 1)""",
    ),
    "pack_summary": _with(
        *SNIFFED,
        select="""SELECT bundle_id, count(*) FILTER (reason NOT IN ('nul', 'binary')) AS file_count,
        count(*) FILTER (reason IN ('nul', 'binary')) AS binary_skipped FROM reasons GROUP BY bundle_id""",
    ),
    "common_parent": _with(*SOURCE_LIST, COMMON, select="SELECT * FROM common"),
    "output_names": _with(
        *SOURCE_LIST, COMMON, NAMED,
        select=f"""SELECT bundle_id, output_name,
        {joined(f"({parent_of('output_name')})", f"({stem_of('output_name')})")} || '_unpacked' AS unpack_name FROM named_out""",
    ),
    "allocate_names": _with(
        ("requests", REQUESTS),
        ("in_use", IN_USE),
        ("slots", f"""SELECT name, n, CASE WHEN n = 0 THEN name ELSE left(name, len(name) - cut) || '_' || n || right(name, cut) END AS candidate
            FROM (SELECT name, unnest(range(0, 10000)) AS n, {ext_cut("name")} AS cut FROM (SELECT DISTINCT name FROM requests))"""),
        ("free", """SELECT name, candidate, row_number() OVER (PARTITION BY name ORDER BY n) AS nth FROM slots
            WHERE candidate NOT IN (SELECT name FROM in_use) AND (n = 0 OR candidate NOT IN (SELECT name FROM requests))"""),
        select=f"""SELECT request_id, r.name, coalesce(candidate, left(r.name, len(r.name) - ({ext_cut("r.name")})) || '_more_' || request_id
            || right(r.name, {ext_cut("r.name")})) AS allocated, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY request_id) AS nth FROM requests) r
        LEFT JOIN free f ON f.name = r.name AND f.nth = r.nth""",
    ),
    "resolve_output_names": _with(
        *SOURCE_LIST, COMMON, NAMED,
        ("given", "SELECT bundle_id, max(explicit) <> 'output.docx' AS given FROM sources GROUP BY bundle_id"),
        ("named", "SELECT bundle_id, output_name FROM named_out"),
        ("in_use", OUT_IN_USE),
        ("requests", "SELECT bundle_id AS request_id, output_name AS name FROM named JOIN given USING (bundle_id) WHERE given IS NOT TRUE"),
        ("slots", f"""SELECT name, n, CASE WHEN n = 0 THEN name ELSE left(name, len(name) - cut) || '_' || n || right(name, cut) END AS candidate
            FROM (SELECT name, unnest(range(0, 10000)) AS n, {ext_cut("name")} AS cut FROM (SELECT DISTINCT name FROM requests))"""),
        ("free", """SELECT name, candidate, row_number() OVER (PARTITION BY name ORDER BY n) AS nth FROM slots
            WHERE candidate NOT IN (SELECT name FROM in_use) AND (n = 0 OR candidate NOT IN (SELECT name FROM requests))"""),
        select="""SELECT n.bundle_id, coalesce(candidate, n.output_name) AS output_name, CAST(NULL AS VARCHAR) AS error FROM named n
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY request_id) AS nth FROM requests) r ON r.request_id = n.bundle_id
        LEFT JOIN free f ON f.name = r.name AND f.nth = r.nth""",
    ),
    "path_parts": _with(
        PAGES, HEADS,
        select=f"""SELECT id, {parent_of("heading")} AS parent, {name_of("heading")} AS name, {stem_of("heading")} AS stem,
        CASE WHEN {ext_cut(name_of("heading"))} > 0 THEN right({name_of("heading")}, {ext_cut(name_of("heading"))} - 1) END AS extension,
        CAST(len(string_split(heading, '/')) AS INT) AS components FROM headings""",
    ),
    "pack_paragraphs": _with(
        *SNIFFED, DECODED,
        ("kept", f"""SELECT bundle_id, path, {lines_of("out")} AS lines FROM decoded JOIN (SELECT doc_id, reason FROM reasons) r
            USING (doc_id) WHERE reason NOT IN ('nul', 'binary') AND NOT ({default_hit("path")})"""),
        select="""SELECT bundle_id, path, len(lines) + 1 AS rows, CAST(len(path) + len(array_to_string(lines, '')) AS BIGINT) AS chars,
        CAST(len(lines) AS INT) AS last_line FROM kept""",
    ),
    "pack_once": _with(
        *SNIFFED, DECODED,
        ("kept", f"""SELECT bundle_id, path, reason NOT IN ('nul', 'binary') AS t, {lines_of("out")} AS lines FROM decoded JOIN (SELECT doc_id, reason FROM reasons) r
            USING (doc_id) WHERE NOT ({default_hit("path")})"""),
        select="""SELECT bundle_id, count(*) FILTER (t) AS file_count, count(*) FILTER (NOT t) AS binary_skipped,
        CAST(sum(len(lines) + 1) FILTER (t) AS BIGINT) AS rows, CAST(sum(len(path) + len(array_to_string(lines, ''))) FILTER (t) AS BIGINT) AS chars
        FROM kept GROUP BY bundle_id""",
    ),
    "pack_many_sources": _with(
        DOCS, PAGES,
        ("kept", f"""SELECT bundle_id, path, -1 AS source_ord FROM doc_files WHERE NOT ({default_hit("path")}) AND NOT contains(path, '/logs/')
            UNION ALL SELECT bundle_id, path, page_id FROM page_files WHERE NOT ({default_hit("path")})"""),
        ("twice", """SELECT bundle_id, arg_min(path, o) AS path FROM (SELECT bundle_id, path, list_sort(list(source_ord))[2] AS o
            FROM kept GROUP BY bundle_id, path HAVING count(*) > 1) GROUP BY bundle_id"""),
        select="""SELECT bundle_id, CAST(NULL AS VARCHAR) AS header, count(*) AS file_count, CAST(0 AS BIGINT) AS binary_skipped,
        CAST(NULL AS VARCHAR) AS output_name, max('duplicate path: ' || t.path) AS error
        FROM kept LEFT JOIN twice t USING (bundle_id) GROUP BY bundle_id""",
    ),
    "roundtrip_diff": _with(
        DIRTY,
        ("files", f"""SELECT bundle_id, path, {NORMAL} AS body, regexp_extract(path, '([0-9])[.][a-z]+$', 1) AS tail FROM dirty_files"""),
        ("counted", "SELECT *, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS n FROM files"),
        select="""SELECT bundle_id, path, CASE WHEN tail IN ('5', '7') THEN 'missing' WHEN tail = '3' THEN 'changed' ELSE 'same' END AS status,
          n AS lines_before, CASE WHEN tail IN ('5', '7') THEN NULL WHEN tail = '3' THEN greatest(n, 1) + 1 ELSE n END AS lines_after FROM counted
        UNION ALL SELECT bundle_id, 'new/' || path, 'added', NULL, n FROM counted WHERE tail = '5'""",
    ),
    "roundtrip_reasons": _with(
        DIRTY,
        ("files", f"""SELECT bundle_id, path, text AS was, {NORMAL} AS content, regexp_extract(path, '([0-9])[.][a-z]+$', 1) AS tail FROM dirty_files"""),
        ("ways", f"SELECT bundle_id, path, was, {ON_THE_WAY} AS now FROM files"),
        ("lists", f"""SELECT *, {lines_of("was")} AS b, {lines_of("now")} AS a FROM ways"""),
        ("kinds", f"""SELECT *, {END.format("b")} = {END.format("a")} AS exact, {END.format(BARE.format("b"))} = {END.format(BARE.format("a"))} AS trimmed,
          {FULL.format("b")} = {FULL.format("a")} AS whole, {BARE.format(FULL.format("b"))} = {BARE.format(FULL.format("a"))} AS bare FROM lists"""),
        select="""SELECT bundle_id, path, CASE WHEN exact THEN 'same' ELSE 'changed' END AS status,
          CASE WHEN exact THEN CASE WHEN rtrim(was, chr(10)) <> rtrim(now, chr(10)) THEN 'line_ends' END WHEN trimmed THEN 'outer_blanks'
            WHEN whole THEN 'blank_lines' WHEN bare THEN 'blanks' ELSE 'content' END AS reason,
          CASE WHEN NOT exact THEN list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i], '') <> coalesce(b[i], ''))[1] END AS first_line
        FROM kinds""",
    ),
    "pack_progress": _with(
        *SNIFFED,
        select=f"""SELECT count(*) AS total, count(*) FILTER (x) AS excluded, count(*) FILTER (NOT x AND t) AS kept,
        count(*) FILTER (NOT x AND NOT t) AS skipped, CAST(sum(length) FILTER (NOT x AND t) AS BIGINT) AS kept_bytes
        FROM (SELECT *, {default_hit("path")} AS x, reason NOT IN ('nul', 'binary') AS t FROM reasons)""",
    ),
    "pack_stream": _with(
        DOCS,
        ("doc_rows", paragraphs_of("doc_files")),
        select=f"""SELECT bundle_id, path, CAST(line_no AS INT) AS line_no, {STYLE} AS style, text FROM doc_rows
        WHERE NOT ({default_hit("path")})""",
    ),
    # Windows of 20 minutes follow from one another; each begins with the next arrival after the last one's end.
    "guard_sources_stream": "WITH RECURSIVE " + _with(
        PAGES,
        ("arrivals", ARRIVALS),
        ("opened", """SELECT bundle_id, path, min(arrived) AS first_s FROM arrivals GROUP BY bundle_id, path
        UNION ALL SELECT o.bundle_id, o.path, min(a.arrived) FROM opened o JOIN arrivals a
          ON a.bundle_id = o.bundle_id AND a.path = o.path AND a.arrived >= o.first_s + 1200 GROUP BY o.bundle_id, o.path"""),
        ("placed", """SELECT a.*, max(o.first_s) AS first_s FROM arrivals a JOIN opened o
          ON a.bundle_id = o.bundle_id AND a.path = o.path AND o.first_s <= a.arrived GROUP BY ALL"""),
        select="""SELECT bundle_id, path, source, CAST(arrived AS BIGINT) AS at_s, source = first_source AS kept, first_source,
        CAST(first_s AS BIGINT) AS first_s FROM (SELECT *, first_value(source) OVER (
          PARTITION BY bundle_id, path, first_s ORDER BY arrived, source) AS first_source FROM placed)""",
    ).removeprefix("WITH "),
    "duplicate_guard_stream": _with(PAGES, select="SELECT DISTINCT bundle_id, path FROM page_files"),
}
ORACLE["watched_tree"] = ORACLE["pack_given_tree"]
